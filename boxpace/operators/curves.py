"""Booking curves."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BASELINE_GLOBAL_LABEL, BASELINE_TYPE_LABEL, DEFAULT, PacingConfig
from ..functions.lead import bin_floor, days_out, in_lead_window, lead_capped, lead_clamped
from ..functions.numeric import safe_ratio
from .cumulate import DAY, SLOT, TIME, day_sums, finish_curve, grid_cum_share, share_of_final, stretch_sums
from .prep import fill_missing, lit_ts, order_columns, past, upcoming
from .quantiles import group_quantiles

EVENT = ["event_name", "event_date"]
QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def event_bin_sums(df: DataFrame, cfg: PacingConfig = DEFAULT, lead: str = "clamp") -> DataFrame:
    """Tickets per (event_name, event_date, d_bin).

    ``lead`` picks the early/late rule: ``clamp`` folds both sides into
    [0, max_lead] (P10), ``cap`` drops late sales and folds early ones (P11),
    ``filter`` keeps 0..max_lead only (P9).
    """
    d = _binned(df, cfg, lead)
    return d.groupBy(*EVENT, "d_bin").agg(F.sum("qty_sold").alias("qty_sold"))


def _binned(df: DataFrame, cfg: PacingConfig, lead: str) -> DataFrame:
    d = df.na.drop(subset=["event_date", "sale_date", "qty_sold"]).withColumn("days_out", days_out())
    if lead == "clamp":
        d = d.withColumn("days_out", lead_clamped("days_out", cfg))
    elif lead == "cap":
        d = d.where(F.col("days_out") >= 0).withColumn("days_out", lead_capped("days_out", cfg))
    else:
        d = d.where(in_lead_window("days_out", cfg))
    return d.withColumn("d_bin", bin_floor("days_out", cfg))


def event_cum_shares(df: DataFrame, cfg: PacingConfig = DEFAULT, lead: str = "clamp", scale: float = 1.0) -> DataFrame:
    """Per-event cumulative share at every bin of the grid (W4 on A13)."""
    return grid_cum_share(_binned(df, cfg, lead), EVENT, cfg, scale=scale)


def curve_from_shares(shares: DataFrame, cfg: PacingConfig = DEFAULT, hi: float = 100.0, scale_out: float = 1.0,
                      names=("median_pct", "p25_pct", "p75_pct"), band: bool = False) -> DataFrame:
    """Median / p25 / p75 of the per-event shares per bin, n = events with a share."""
    med, p25, p75 = names
    q = group_quantiles(shares, ["d_bin"], "cum_share", {med: 0.5, p25: 0.25, p75: 0.75}, cfg, n="n", n_rows="_rows")
    curve = finish_curve(_on_grid(shares, q, cfg), [p25, med, p75], hi, band=(p25, med, p75) if band else None)
    if scale_out != 1.0:
        for c in (p25, med, p75):
            curve = curve.withColumn(c, F.least(F.col(c) * scale_out, F.lit(100.0)))
    return curve.select("d_bin", med, p25, p75, F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def _on_grid(df: DataFrame, q: DataFrame, cfg: PacingConfig) -> DataFrame:
    """``q`` (a row per d_bin) on the full bin grid; empty if no row of ``df`` had reached any bin (``_rows``)."""
    grid = df.sparkSession.range(0, cfg.max_lead + 1, cfg.bin_size).select(F.col("id").cast("int").alias("d_bin"))
    # At most one row per bin on both sides: a bounded broadcast and a window of 41 rows.
    curve = grid.join(F.broadcast(q), "d_bin", "left")
    return curve.withColumn("_any", F.sum("_rows").over(Window.partitionBy())).where(F.col("_any") > 0).drop("_any", "_rows")


def baseline_candidates(df_past: DataFrame, event_types=None, cfg: PacingConfig = DEFAULT,
                        mode: str = "Global") -> DataFrame:
    """Cohort ladder of the baseline curve (J8): one row, the chosen candidate.

    Candidates in order: the single selected event type (if exactly one is
    selected and mode is not Global), then all events. The first with at least
    ``min_events_baseline`` distinct (name, date) events wins; global always
    qualifies. All candidate counts come from one aggregation.
    """
    ev = F.struct(*[F.col(c) for c in EVENT])
    cands = []
    if mode != "Global" and event_types and len(event_types) == 1:
        cands.append((BASELINE_TYPE_LABEL, F.col("event_type") == F.lit(event_types[0]), event_types[0]))
    cands.append((BASELINE_GLOBAL_LABEL, F.lit(True), None))
    aggs = [F.count_distinct(F.when(cond, ev)).alias(f"_n{i}") for i, (_, cond, _) in enumerate(cands)]
    counts = df_past.agg(*aggs)
    choice = None
    for i, (label, _, value) in enumerate(cands):
        ok = (F.col(f"_n{i}") >= cfg.min_events_baseline) | F.lit(label == BASELINE_GLOBAL_LABEL)
        row = F.struct(F.lit(label).alias("cohort_label"), F.col(f"_n{i}").cast("long").alias("n_events"),
                       F.lit(value).cast("string").alias("event_type"))
        choice = F.when(ok, row) if choice is None else choice.when(ok, row)
    return counts.select(choice.alias("c")).select("c.*")


def baseline_curve(df: DataFrame, as_of: dt.date, cfg: PacingConfig = DEFAULT, event_types=None,
                   mode: str = "Global") -> tuple[DataFrame, DataFrame]:
    """Historic booking curve with its cohort (R3): (curve, cohort row).

    Past events of the chosen cohort; sales clamped into [0, max_lead];
    per-event cumulative share on the full grid; quartiles across events per
    bin; forward fill, running max, in percent.
    """
    df_past = past(df, as_of)
    cohort = baseline_candidates(df_past, event_types, cfg, mode)
    chosen = df_past
    if mode != "Global" and event_types and len(event_types) == 1:
        pick = cohort.select("cohort_label").scalar()
        chosen = df_past.where((pick == F.lit(BASELINE_GLOBAL_LABEL)) | (F.col("event_type") == event_types[0]))
    shares = event_cum_shares(chosen, cfg, lead="clamp", scale=1.0)
    curve = curve_from_shares(shares, cfg, hi=1.0, scale_out=100.0, names=("median_pct", "p25_pct", "p75_pct"))
    return curve.select("d_bin", "median_pct", "p25_pct", "p75_pct", "n").orderBy(F.col("d_bin").desc()), cohort


def global_pacing_curve(df: DataFrame, as_of: dt.date, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Past-event curve with late sales dropped, early ones in the last bin, band ordered."""
    shares = event_cum_shares(past(df, as_of), cfg, lead="cap", scale=100.0)
    curve = curve_from_shares(shares, cfg, hi=100.0, band=True, names=("median_pct", "p25_pct", "p75_pct"))
    return curve.select("d_bin", "median_pct", "p25_pct", "p75_pct", "n").orderBy(F.col("d_bin").desc())


def current_curve(df: DataFrame, as_of: dt.date, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Mean cumulative % of upcoming events over the bins that occur.

    Empty with fewer than ``current_min_events`` events. The mean over events
    of cum_e(b) / T_e equals the suffix sum over bins c >= b of
    S(c) = sum_e q(e, c) / T_e, divided by the number of events with T_e != 0;
    so only per-(event, bin) sums and per-bin totals are shuffled, and no
    event x bin grid is built.
    """
    fut = upcoming(df, as_of).na.drop(subset=["event_date", "sale_date", "qty_sold"])
    fut = fut.withColumn("days_out", days_out()).where(in_lead_window("days_out", cfg))
    fut = fut.withColumn("d_bin", bin_floor("days_out", cfg))
    eb = fut.groupBy(*EVENT, "d_bin").agg(F.sum("qty_sold").alias("q"))
    eb = eb.withColumn("t", F.sum("q").over(Window.partitionBy(*EVENT)))
    per_bin = eb.groupBy("d_bin").agg(F.sum(safe_ratio("q", "t")).alias("s"))
    ev = F.struct(*[F.col(c) for c in EVENT])
    counts = eb.agg(F.struct(F.count_distinct(ev).alias("all"),
                             F.count_distinct(F.when(F.col("t") != 0, ev)).alias("valid")).alias("c")).scalar()
    n_all, n_valid = counts.getField("all"), counts.getField("valid")
    w = Window.orderBy(F.col("d_bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = per_bin.withColumn("cum_pct", F.lit(100.0) * safe_ratio(F.sum(F.coalesce("s", F.lit(0.0))).over(w),
                                                                    n_valid.cast("double")))
    return out.where(n_all >= cfg.current_min_events).select("d_bin", "cum_pct").orderBy(F.col("d_bin").desc())


def curve_sample_size(curve: DataFrame) -> DataFrame:
    """n at bin 0, else the n of the last (lowest) bin, else 0 (P20)."""
    return curve.agg(F.coalesce(F.max(F.when(F.col("d_bin") == 0, F.col("n"))),
                                F.min_by("n", "d_bin"), F.lit(0)).cast("long").alias("n"))


def event_pacing(df: DataFrame, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Max cumulative % per (event_instance, d_bin) with the instance's first attributes.

    Running sums per instance in booking order (W1), without a percentage where the
    instance's final is not above 0. Within a bin, type, weekday, venue and date are each the first
    one in booking order that is not NULL.
    """
    d = fill_missing(df).withColumn("days_out", days_out()).where(in_lead_window("days_out", cfg))
    d = d.withColumn("d_bin", bin_floor("days_out", cfg))
    attributes = ("event_type", "weekday", "venue", "event_date")
    order = order_columns(d, cfg)
    d = d.select(*dict.fromkeys(["event_instance", *attributes, "days_out", "d_bin", "qty_sold", *order]))
    # Stretches of a day, then days: at each level the highest running sum and the first attributes move up.
    by = F.struct(*[F.col(c) for c in order])
    first = {f"_f_{c}": F.min_by(F.col(c), F.when(F.col(c).isNotNull(), by)) for c in attributes}
    stretches = stretch_sums(d, "event_instance", cfg, carry={**first, "d_bin": F.first("d_bin")})
    by = F.struct(TIME, SLOT)
    first = {c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), by)) for c in first}
    days = day_sums(stretches, "event_instance", carry={**first, "d_bin": F.first("d_bin")})
    return days.groupBy("event_instance", "d_bin").agg(
        *[F.min_by(F.col(f"_f_{c}"), F.when(F.col(f"_f_{c}").isNotNull(), F.col(DAY))).alias(c) for c in attributes],
        F.max("_rs_day_top").alias("_top"), F.first("final_qty").alias("_final")).select(
        "event_instance", "d_bin", *attributes, share_of_final("_top", "_final", positive_final=True).alias("cum_pct"))


def global_curve_from_pacing(pacing: DataFrame, as_of: dt.date, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Quartiles of past instances' cum % per bin, grid-filled and monotone."""
    return global_curve_of(pacing.where(F.col("event_date") < lit_ts(as_of)), cfg)


def global_curve_of(hist: DataFrame, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """:func:`global_curve_from_pacing` of past instances' pacing rows."""
    q = group_quantiles(hist, ["d_bin"], "cum_pct",
                        {"median_cum_pct": 0.5, "p25_cum_pct": 0.25, "p75_cum_pct": 0.75}, cfg, n_rows="_rows")
    curve = finish_curve(_on_grid(hist, q, cfg), ["p25_cum_pct", "median_cum_pct", "p75_cum_pct"], 100.0,
                         band=("p25_cum_pct", "median_cum_pct", "p75_cum_pct"))
    return curve.select("d_bin", "median_cum_pct", "p25_cum_pct", "p75_cum_pct").orderBy(F.col("d_bin").desc())
