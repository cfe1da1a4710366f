"""Composite reports: the user-level entry points.

Each returns lazy DataFrames; nothing runs until an action on one of them.
"""
from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, PacingConfig
from ..operators import compare as CMP
from ..operators import curves as CV
from ..operators import timing as TM
from ..operators.cohorts import cohort_stats
from ..operators.kpi import kpis as _kpis
from ..functions.lead import lead_bucket_closed, weekday_name
from ..operators.prep import lit_ts, post_slice, pre_slice, window_label, with_lead
from .watchlist import watchlist


def _sales_by_event(base: DataFrame, cfg: PacingConfig) -> DataFrame:
    """Sums per event, sale window, sale weekday and lead bucket: all that the small tables need of the sales.

    A group's ``sale_date`` and ``days_out`` are its latest and largest; any of its sales has the same window, weekday and bucket.
    They, and the quantity, are named by every reader, so the readers' plans share one shuffle.
    """
    s = base.groupBy(window_label("sale_date", cfg).alias("_w"), weekday_name("sale_date").alias("_d"), lead_bucket_closed("days_out", cfg).alias("_b"),
                     "event_type", "event_instance", "event_name").agg(
        F.sum("qty_sold").alias("qty_sold"), F.max("sale_date").alias("sale_date"), F.max("days_out").alias("days_out"))
    return (s.where(F.col("sale_date").isNotNull() | F.col("days_out").isNotNull())
            .select("event_type", "event_instance", "event_name", "qty_sold", "sale_date", "days_out"))


def derive_core(fact: DataFrame, as_of: dt.date, cfg: PacingConfig = DEFAULT) -> dict[str, DataFrame]:
    """The nine derived tables (R5): base, event pacing, cohort library, global curve,
    average tickets, category shares pre / post, common events, weekday heatmap.

    In one query the tables read the sales three times: base, one aggregate for the five small tables, and pacing,
    whose rows, one per event instance and bin, are shuffled once for the three tables built on them.
    """
    base = with_lead(fact, cfg)
    pacing = CV.event_pacing(fact, cfg)
    past = F.count_if(F.col("event_date") < lit_ts(as_of))
    shared = pacing.groupBy(*pacing.columns).agg(F.count(F.lit(1)).alias("_n"), past.alias("_past"))
    history = shared.where((F.col("_past") > 0) & (F.col("_n") > 0)).select(*pacing.columns)
    small = _sales_by_event(base, cfg)
    return {
        "base": base,
        "event_pacing": shared.where((F.col("_past") >= 0) & (F.col("_n") > 0)).select(*pacing.columns),
        "cohort_library": cohort_stats(history, cfg),
        "global_pacing_curve": CV.global_curve_of(history, cfg),
        "avg_tickets": CMP.avg_tickets_pre_post(small, cfg),
        "category_share_pre": CMP.category_share(pre_slice(small, cfg)),
        "category_share_post": CMP.category_share(post_slice(small, cfg)),
        "events_pre_post": CMP.events_common(small, cfg),
        "dows_heatmap": TM.sales_heatmap(small, cfg),
    }


def core_long(tables: dict[str, DataFrame], order_key: list[str]) -> DataFrame:
    """The derived tables in one long form (tbl, key, measure, value).

    ``key`` joins the row's key columns with ``|``, an absent one as an empty text.
    """
    keys = {"base": order_key, "event_pacing": ["event_instance", "d_bin"],
            "cohort_library": ["tier", "event_type", "weekday", "venue", "d_bin"], "global_pacing_curve": ["d_bin"],
            "avg_tickets": ["window", "event_type"], "category_share_pre": ["event_type"],
            "category_share_post": ["event_type"], "events_pre_post": ["event_name"],
            "dows_heatmap": ["weekday", "lead_bucket"]}
    values = {"base": ["days_out", "d_bin"], "event_pacing": ["cum_pct"],
              "cohort_library": ["median_cum_pct", "p25_cum_pct", "p75_cum_pct", "sample_size"],
              "global_pacing_curve": ["median_cum_pct", "p25_cum_pct", "p75_cum_pct"], "avg_tickets": ["avg_tickets"],
              "category_share_pre": ["share_ratio"], "category_share_post": ["share_ratio"],
              "events_pre_post": ["qty_pre", "qty_post"], "dows_heatmap": ["share"]}
    parts = []
    for name, df in tables.items():
        # Whole numbers as such, so keys don't depend on how an engine prints a double.
        text = [F.coalesce((F.col(k).cast("bigint") if t in ("double", "float") else F.col(k)).cast("string"), F.lit(""))
                for k in keys[name] for t in [dict(df.dtypes)[k]] if not (name == "base" and t == "double")]
        pairs = F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value")) for v in values[name]])
        parts.append(df.select(F.lit(name).alias("tbl"), F.concat_ws("|", *text).alias("key"), F.explode(pairs).alias("m"))
                     .select("tbl", "key", "m.*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def booking_curves(fact: DataFrame, filtered: DataFrame, as_of: dt.date, cfg: PacingConfig = DEFAULT,
                   event_types=None, mode: str = "Global") -> dict[str, DataFrame]:
    """Historic baseline on the whole fact with its cohort (R3) and the current overlay
    on the filtered slice (R4)."""
    curve, cohort = CV.baseline_curve(fact, as_of, cfg, event_types, mode)
    return {"baseline": curve, "cohort": cohort, "sample_size": CV.curve_sample_size(curve),
            "current": CV.current_curve(filtered, as_of, cfg)}


def kpis(fact: DataFrame, as_of: dt.date, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Time-boxed KPIs with the watchlist's behind share."""
    return _kpis(with_lead(fact, cfg), watchlist(fact, as_of, cfg).summary, as_of)


def period_compare(fact: DataFrame, cfg: PacingConfig = DEFAULT) -> dict[str, DataFrame]:
    """Category totals pre / post, top categories, top common events (R7), type averages
    by period (A3) and the share shift (A28)."""
    base = with_lead(fact, cfg)
    return {
        "categories_pre": CMP.categories_pre(fact, cfg),
        "categories_post": CMP.categories_post(fact, cfg),
        "top_categories": CMP.top_categories_pre_post(fact, cfg),
        "top_events": CMP.events_common(fact, cfg),
        "avg_by_type": CMP.pick_top_types(CMP.avg_tickets_by_type(fact, cfg), cfg),
        "share_shift": CMP.share_shift(CMP.category_share(pre_slice(base, cfg)),
                                       CMP.category_share(post_slice(base, cfg)), cfg),
    }


def timing(fact: DataFrame, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Sale weekday x lead bucket share of all tickets."""
    return TM.timing_heatmap(fact, cfg)


def trend(fact: DataFrame) -> dict[str, DataFrame]:
    """Season totals, monthly totals with the 3-month mean, histogram of months."""
    return {"seasons": TM.season_totals(fact), "monthly": TM.monthly_trend(fact),
            "histogram": TM.monthly_histogram(fact)}
