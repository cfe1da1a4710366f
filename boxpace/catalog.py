"""Registered queries: one per operator / report, run on the driver's tables.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame. Columns are
named like the DuckDB oracle (:mod:`boxpace.oracles`); doubles are rounded to
6 places and integers widened to bigint so both sides compare value by value.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ByteType, DateType, DoubleType, FloatType, IntegerType, ShortType, TimestampNTZType,
                               TimestampType)

from .operators import curves
from .sources import tables as T

CFG = T.FIXTURE_CFG
AS_OF = T.FIXTURE_AS_OF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def present(df: DataFrame) -> DataFrame:
    """Round doubles to 6 places, widen small integers to bigint, dates as ISO text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, (IntegerType, ShortType, ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: present(fn(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return deco


# --- booking curves --------------------------------------------------------

@query("r3_baseline_curve")
def _r3(spark, d):
    """Historic booking curve, global cohort, as of the fixture date."""
    curve, _ = curves.baseline_curve(T.fact(spark, d), AS_OF, CFG)
    return curve


# --- watchlist -------------------------------------------------------------

from .plans import watchlist as W  # noqa: E402


def _wl(spark, d, min_cohort=None):
    cfg = CFG if min_cohort is None else CFG.with_(min_cohort=min_cohort)
    return W.watchlist(T.fact(spark, d), AS_OF, cfg)


@query("w2_running_name")
def _w2(spark, d):
    """Running qty / final / % per event name in booking order, every lead-window row."""
    from .operators.cumulate import running_share
    from .operators.prep import pacing_rows
    s = running_share(pacing_rows(T.fact(spark, d), CFG), "event_name", CFG, pct_col="hist_cum_pct")
    return s.select(*T.FIXTURE_ORDER_KEY, "event_name", "days_out", "d_bin", "cum_qty", "final_qty", "hist_cum_pct")


@query("a15_cohort_medians")
def _a15(spark, d):
    """Median running % and distinct events per tier, keys and bin (past events)."""
    from .operators.cohorts import cohort_library
    m, _ = cohort_library(W.library_rows(T.fact(spark, d), AS_OF, CFG), CFG)
    return m


@query("a16_cohort_finals")
def _a16(spark, d):
    """Row-weighted median final and distinct events per tier and keys."""
    from .operators.cohorts import cohort_library
    _, f = cohort_library(W.library_rows(T.fact(spark, d), AS_OF, CFG), CFG)
    return f


@query("a14_sold_now")
def _a14(spark, d):
    """Upcoming events: tickets so far, min days_out, first label, bin."""
    return W.sold_now(T.fact(spark, d), AS_OF, CFG)


@query("j6_cohort_resolution")
def _j6(spark, d):
    """Chosen tier, typical % at the bin, n and baseline final for every upcoming event."""
    return _wl(spark, d).scored.select(*W.EVENT_KEYS, "d_bin", "tier", "median_at_d", "n", "baseline_final",
                                       "n_final")


@query("r2_watchlist")
def _r2(spark, d):
    """Top-50 watchlist (min cohort 20)."""
    return _wl(spark, d).table


@query("r2_watchlist_min5")
def _r2_5(spark, d):
    """Watchlist with min cohort 5 (reaches the most specific tier)."""
    return _wl(spark, d, 5).table


@query("r2_watchlist_min62")
def _r2_62(spark, d):
    """Watchlist with min cohort 62 (global tier)."""
    return _wl(spark, d, 62).table


@query("r2_watchlist_min65")
def _r2_65(spark, d):
    """Watchlist with min cohort 65 (last-resort path)."""
    return _wl(spark, d, 65).table


def _scored(spark, d, **options):
    s = W.watchlist(T.fact(spark, d), AS_OF, CFG.with_(**options)).scored
    return s.select("event", "event_name", F.date_format("event_date", "yyyy-MM-dd HH:mm:ss").alias("event_date"),
                    F.col("days_out").cast("long").alias("days_out"), "sold_so_far_pct", "typical_at_day_pct", "gap_pp",
                    F.col("ticket_count").alias("tickets_so_far"), "status", "cohort")


@query("r2_watchlist_strict")
def _r2_strict(spark, d):
    """Every scored event where sales after the as-of day don't count."""
    return _scored(spark, d, strict_as_of=True)


@query("r2_watchlist_by_instance")
def _r2_instance(spark, d):
    """Every scored event against a library whose events are label and date, not names."""
    return _scored(spark, d, event_key="event_instance")


@query("a26_watch_summary")
def _a26(spark, d):
    """Evaluated and behind counts before the sold-out filter and the top-k cut."""
    return _wl(spark, d).summary


@query("a27_tiers_used")
def _a27(spark, d):
    """Distinct cohort tiers used by the watchlist."""
    return _wl(spark, d).tiers


@query("a24_status_counts")
def _a24(spark, d):
    """Behind / on pace / ahead counts of the shown watchlist rows."""
    return W.status_counts(_wl(spark, d).table)


@query("r9_checkpoints")
def _r9(spark, d):
    """D-30 and D-7 weighted checkpoint cards over the shown watchlist rows."""
    return W.checkpoints(_wl(spark, d).table, CFG)


# --- ingest: raw text to clean fact ---------------------------------------

from .plans import enrich as R  # noqa: E402
from .functions import classify as C  # noqa: E402

ENRICHED = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "sale_date", "event_date", "event_name",
            "event_part", "qty_sold", "amount", "event_category", "event_type", "event_label", "event_instance",
            "weekday", "venue", "season"]


def _enriched(spark, d):
    return R.enrich(T.raw_sales(spark, d), CFG)


@query("r1_enrich")
def _r1(spark, d):
    """Dirty text rows to the typed, classified, labelled fact (headers, coercion, drops, F1-F9, P6)."""
    return _enriched(spark, d).select(*ENRICHED)


@query("s1_csv_round_trip")
def _s1(spark, d):
    """The text rows written as CSV to the shared folder, listed, read back by header and made into the fact."""
    import uuid

    from .session import ensure_checkpoint_dir
    from .sources import csv as S
    folder = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4()}"
    S.write_csv(T.raw_sales(spark, d), folder)
    files = S.list_data_files(spark, folder).agg(F.count_if(F.col("length") > 0).alias("_files"))
    back = R.load_sales(spark, folder, CFG).select(*[F.col(c).cast("long") if c.startswith("l_") else F.col(c) for c in ENRICHED])
    return back.withColumn("has_files", F.lit(files.scalar() > 0))


@query("p3_loose_dates")
def _p3(spark, d):
    """Dates written in several ways, with names, offsets and times of day, as timestamps."""
    return T.date_texts(spark, d).withColumn("parsed", R.to_timestamp("date_text"))


@query("f1_category_raw")
def _f1(spark, d):
    """Category normaliser on the raw category column, per distinct raw value."""
    raw = (T.raw_sales(spark, d).select(F.col("`Event Category`").alias("raw_category"))
           .groupBy("raw_category").agg(F.count(F.lit(1)).alias("n_rows")))
    return raw.withColumn("category", C.normalize_category(F.col("raw_category"), None, CFG))


@query("f1_category_from_name")
def _f1b(spark, d):
    """Category normaliser without a category column: keyword fallback on the event name."""
    e = _enriched(spark, d).drop("event_category").groupBy("event_name").agg(F.count(F.lit(1)).alias("n_rows"))
    return e.withColumn("category", C.normalize_category(None, F.col("event_name"), CFG))


@query("f3_event_type")
def _f3(spark, d):
    """Event-type ladder per distinct (part, name, category) of the ingested rows."""
    return (_enriched(spark, d).groupBy("event_part", "event_name", "event_category", "event_type")
            .agg(F.count(F.lit(1)).alias("n_rows")))


@query("f4_collab_category")
def _f4(spark, d):
    """Regex categoriser per distinct ingested event name."""
    e = _enriched(spark, d).groupBy("event_name").agg(F.sum("qty_sold").alias("qty_sold"))
    return e.withColumn("collab_category", C.collab_category("event_name", CFG))


@query("f8_title_case")
def _f8(spark, d):
    """Title case (letters after any non-letter) of every distinct trimmed raw part and name."""
    raw = T.raw_sales(spark, d)
    vals = (raw.select(C.strip(F.col("`Event Part`")).alias("text"))
            .unionByName(raw.select(C.strip(F.col("`EVENT NAME`")).alias("text"))).distinct())
    return vals.withColumn("title", C.title_case(F.col("text")))


# --- derived tables (derive_core) ------------------------------------------

from .operators import compare as CMP, timing as TM, prep as P  # noqa: E402
from .operators.cohorts import cohort_stats  # noqa: E402
from .operators.kpi import kpis  # noqa: E402
from .operators.allocate import allocate  # noqa: E402
from .functions import lead as L  # noqa: E402


def _base(spark, d):
    return P.with_lead(T.fact(spark, d), CFG)


@query("a18_event_pacing")
def _a18(spark, d):
    """Max running % per (event instance, bin) with the instance's first type, weekday, venue, date."""
    return curves.event_pacing(T.fact(spark, d), CFG)


@query("a17_cohort_stats")
def _a17(spark, d):
    """p25 / median / p75 of instance cum % and distinct instances per tier and bin, past instances."""
    pac = curves.event_pacing(T.fact(spark, d), CFG)
    return cohort_stats(pac.where(F.col("event_date") < P.lit_ts(AS_OF)), CFG)


@query("a21_global_curve")
def _a21(spark, d):
    """Global curve from event pacing: quartiles per bin, grid-filled, monotone, band-ordered."""
    return curves.global_curve_from_pacing(curves.event_pacing(T.fact(spark, d), CFG), AS_OF, CFG)


@query("a2_avg_tickets")
def _a2(spark, d):
    """Average tickets per event instance by type, pre and post windows stacked."""
    return CMP.avg_tickets_pre_post(_base(spark, d), CFG)


@query("a1_category_share_pre")
def _a1pre(spark, d):
    """Share of tickets per event type, pre window."""
    return CMP.category_share(P.pre_slice(_base(spark, d), CFG))


@query("a1_category_share_post")
def _a1post(spark, d):
    """Share of tickets per event type, post window."""
    return CMP.category_share(P.post_slice(_base(spark, d), CFG))


@query("a7_events_common")
def _a7(spark, d):
    """Top-12 events sold in both windows by combined tickets."""
    return CMP.events_common(_base(spark, d), CFG)


@query("a11_sales_heatmap")
def _a11(spark, d):
    """Share of each closed lead bucket within the sale weekday."""
    return TM.sales_heatmap(_base(spark, d), CFG)


@query("a23_kpis")
def _a23(spark, d):
    """Time-boxed KPIs with the watchlist's behind share."""
    f = T.fact(spark, d)
    return kpis(P.with_lead(f, CFG), W.watchlist(f, AS_OF, CFG).summary, AS_OF)


# --- period comparison, trend, timing ---------------------------------------

@query("a5_categories_pre")
def _a5pre(spark, d):
    """Tickets per regex category of the ingested names, pre window, unmapped dropped."""
    return CMP.categories_pre(_enriched(spark, d), CFG)


@query("a5_categories_post")
def _a5post(spark, d):
    """Tickets per regex category of the ingested names, post window, unmapped dropped."""
    return CMP.categories_post(_enriched(spark, d), CFG)


@query("a6_top_categories")
def _a6(spark, d):
    """Top-6 regex categories of the ingested names by pre volume with their post volume."""
    return CMP.top_categories_pre_post(_enriched(spark, d), CFG)


@query("a3_avg_tickets_by_type")
def _a3(spark, d):
    """Avg tickets per (name, date) event by type and period, both periods per type, top-12 types."""
    return CMP.pick_top_types(CMP.avg_tickets_by_type(T.fact(spark, d), CFG), CFG)


@query("a28_share_shift")
def _a28(spark, d):
    """Type shares per window re-normalised to 100."""
    b = _base(spark, d)
    return CMP.share_shift(CMP.category_share(P.pre_slice(b, CFG)), CMP.category_share(P.post_slice(b, CFG)), CFG)


@query("a8_season_totals")
def _a8(spark, d):
    """Tickets per season with its start year."""
    return TM.season_totals(T.fact(spark, d))


@query("w8_monthly_trend")
def _w8(spark, d):
    """Monthly tickets with the centred 3-month mean."""
    return TM.monthly_trend(T.fact(spark, d))


@query("a10_monthly_histogram")
def _a10(spark, d):
    """30 equal-width bins of monthly ticket totals."""
    return TM.monthly_histogram(T.fact(spark, d))


@query("a12_timing_heatmap")
def _a12(spark, d):
    """Sale weekday x half-open lead bucket share of all tickets (7 x 6), gated."""
    return TM.timing_heatmap(T.fact(spark, d), CFG)


# --- curves and their parts ---------------------------------------------------

@query("a13_event_bin_sums")
def _a13(spark, d):
    """Tickets per (event, date, bin) with sales clamped into the lead window."""
    return curves.event_bin_sums(T.fact(spark, d), CFG, lead="clamp")


@query("w4_event_cum_share")
def _w4(spark, d):
    """Cumulative share per past event at every bin of the grid, 120 -> 0."""
    return curves.event_cum_shares(P.past(T.fact(spark, d), AS_OF), CFG, lead="clamp").drop("event_total")


@query("a20_global_pacing_curve")
def _a20(spark, d):
    """Past-event curve, late sales dropped, early ones capped, band ordered."""
    return curves.global_pacing_curve(T.fact(spark, d), AS_OF, CFG)


@query("a22_current_curve")
def _a22(spark, d):
    """Mean cumulative % of upcoming events over the bins that occur."""
    return curves.current_curve(T.fact(spark, d), AS_OF, CFG)


SELECTED_TYPE = "STANDARD"


@query("j8_baseline_cohort")
def _j8(spark, d):
    """Baseline cohort ladder with one selected event type: chosen label and event count."""
    return curves.baseline_candidates(P.past(T.fact(spark, d), AS_OF), [SELECTED_TYPE], CFG, mode="Cohort")


@query("r3_baseline_curve_type")
def _r3t(spark, d):
    """Booking curve of the cohort chosen for one selected event type."""
    c, _ = curves.baseline_curve(T.fact(spark, d), AS_OF, CFG, event_types=[SELECTED_TYPE], mode="Cohort")
    return c


@query("p20_curve_sample_size")
def _p20(spark, d):
    """Sample size of the baseline curve at bin 0."""
    c, _ = curves.baseline_curve(T.fact(spark, d), AS_OF, CFG)
    return curves.curve_sample_size(c)


# --- allocation ---------------------------------------------------------------

@query("u7_allocation")
def _u7(spark, d):
    """Each event's ticket total split over its sales in proportion to the amount (cents)."""
    f = T.fact(spark, d).select(*T.FIXTURE_ORDER_KEY, "event_name", "event_date", "qty_sold",
                                F.round(F.col("amount") * 100).cast("bigint").alias("cents"))
    out = allocate(f, ["event_name", "event_date"], "cents", None, list(T.FIXTURE_ORDER_KEY), total_of="qty_sold")
    return out.select(*T.FIXTURE_ORDER_KEY, "event_name", "event_date", F.col("qty_sold_sum").alias("event_total"), "cents", "alloc")


# --- lead days, buckets, slices, periods --------------------------------------

@query("p8_lead_days")
def _p8(spark, d):
    """days_out, bin, the two-sided clamp and the window flag for every sale."""
    b = _base(spark, d)
    return b.select(*T.FIXTURE_ORDER_KEY, "days_out", "d_bin",
                    L.lead_clamped("days_out", CFG).alias("lead_clamped"),
                    L.in_lead_window("days_out", CFG).cast("int").alias("in_window"))


@query("p11_lead_capped")
def _p11(spark, d):
    """Late sales dropped, early ones capped at the lead window, then binned."""
    b = _base(spark, d).where(F.col("days_out") >= 0)
    capped = L.lead_capped("days_out", CFG)
    return b.select(*T.FIXTURE_ORDER_KEY, capped.alias("lead_capped"), L.bin_floor(capped, CFG).alias("d_bin"))


@query("f12_lead_bucket_closed")
def _f12(spark, d):
    """Tickets per closed lead bucket (with unknown, >120, <0)."""
    b = _base(spark, d)
    return b.groupBy(L.lead_bucket_closed("days_out", CFG).alias("lead_bucket")).agg(
        F.sum("qty_sold").alias("qty_sold"), F.count(F.lit(1)).alias("n_rows"))


@query("f13_lead_bucket_half_open")
def _f13(spark, d):
    """Tickets per half-open lead bucket (NULL outside the edges)."""
    b = _base(spark, d)
    return b.groupBy(L.lead_bucket_half_open("days_out", CFG).alias("lead_bucket")).agg(
        F.sum("qty_sold").alias("qty_sold"), F.count(F.lit(1)).alias("n_rows"))


@query("f9_sale_weekday")
def _f9(spark, d):
    """Tickets per sale weekday with its Monday-first rank."""
    b = T.fact(spark, d).withColumn("sale_weekday", L.weekday_name("sale_date"))
    return (b.groupBy("sale_weekday").agg(F.sum("qty_sold").alias("qty_sold"))
            .withColumn("weekday_rank", L.weekday_rank("sale_weekday")))


SLICE_SEASONS = ["1996-97", "1997-98", "1998-99", "1999-00"]
SLICE_CHANNELS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query("p13_slice_filter")
def _p13(spark, d):
    """Seasons IN, channels IN, event date within whole days."""
    import datetime as _dt
    f = P.slice_filter(T.fact(spark, d), SLICE_SEASONS, SLICE_CHANNELS, _dt.date(1996, 6, 1), _dt.date(1999, 12, 22))
    return f.select(*T.FIXTURE_ORDER_KEY, "season", "channel", "event_date")


@query("p14_default_seasons")
def _p14s(spark, d):
    """The last five seasons by text order."""
    return P.default_seasons(T.fact(spark, d))


@query("t6_all_seasons")
def _t6s(spark, d):
    """Every season of the fact."""
    return P.all_seasons(T.fact(spark, d))


@query("t6_all_channels")
def _t6c(spark, d):
    """Every sales channel of the fact."""
    return P.all_channels(T.fact(spark, d))


@query("p14_date_bounds")
def _p14d(spark, d):
    """Event-date picker bounds for the as-of date."""
    return P.default_date_bounds(T.fact(spark, d), AS_OF)


@query("p15_default_as_of")
def _p15(spark, d):
    """Default as-of: the latest sale day."""
    return P.default_as_of(T.fact(spark, d))


@query("p17_window_label")
def _p17(spark, d):
    """Rows and tickets per pre / bridge / post sale window."""
    return T.fact(spark, d).groupBy(P.window_label("sale_date", CFG).alias("window")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("qty_sold").alias("qty_sold"))


@query("p18_period_label")
def _p18(spark, d):
    """Rows and tickets per two-way period."""
    return P.periodize(T.fact(spark, d), CFG).groupBy("period").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("qty_sold").alias("qty_sold"))


@query("p19_past_upcoming")
def _p19(spark, d):
    """Rows and distinct events on each side of the as-of date."""
    f = T.fact(spark, d)
    side = F.when(F.col("event_date") < P.lit_ts(AS_OF), F.lit("past")).otherwise(F.lit("upcoming"))
    return f.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n_rows"),
                                             F.count_distinct("event_instance").alias("n_events"))


@query("s7_data_stamp")
def _s7(spark, d):
    """First and last sale and the row count."""
    from .sources.csv import data_stamp
    return data_stamp(T.fact(spark, d))


@query("a9_monthly_totals")
def _a9(spark, d):
    """Tickets per sale month."""
    return TM.monthly_totals(T.fact(spark, d))


@query("a4_category_totals")
def _a4(spark, d):
    """Tickets per regex category of the ingested names over all sales, unmapped dropped."""
    return CMP.category_totals(_enriched(spark, d), CFG)


@query("w1_running_instance")
def _w1(spark, d):
    """Running qty / final / % per event instance in booking order, every lead-window row."""
    from .operators.cumulate import running_share
    from .operators.prep import pacing_rows
    s = running_share(pacing_rows(T.fact(spark, d), CFG), "event_instance", CFG, pct_col="cum_pct")
    return s.select(*T.FIXTURE_ORDER_KEY, "event_instance", "days_out", "d_bin", "cum_qty", "final_qty", "cum_pct")


# --- refunds and the derived tables as a whole --------------------------------------

@query("a18_event_pacing_refunds")
def _a18r(spark, d):
    """Event pacing where every fifth event has refunds only (no percentage without a positive final)."""
    return curves.event_pacing(T.fact_with_refunds(spark, d), CFG)


@query("a21_global_curve_refunds")
def _a21r(spark, d):
    """Global curve over the same events."""
    return curves.global_curve_from_pacing(curves.event_pacing(T.fact_with_refunds(spark, d), CFG), AS_OF, CFG)


@query("r5_derive_core")
def _r5(spark, d):
    """Every derived table of the core, in long form: table, key of the row, measure, value."""
    from .plans.reports import core_long, derive_core
    return core_long(derive_core(T.fact(spark, d), AS_OF, CFG), list(T.FIXTURE_ORDER_KEY))
