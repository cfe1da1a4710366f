"""Watchlist report (R2) and checkpoint cards."""
from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, STATUS_AHEAD, STATUS_BEHIND, STATUS_ON_PACE, PacingConfig
from ..functions.lead import bin_floor
from ..functions.numeric import clip, pace_status, round_half_even, round_to_long
from ..operators.cohorts import cohort_figures, cohort_label, resolve_figures, tier_keys
from ..operators.cumulate import running_share
from ..operators.prep import known_sales, lit_ts, order_columns, pacing_rows, past, upcoming

EVENT_KEYS = ["event_name", "event_date", "event_type", "weekday", "venue"]


@dataclass
class Watchlist:
    table: DataFrame      # top rows after the sold-out filter
    summary: DataFrame    # one row: evaluated, behind
    tiers: DataFrame      # distinct tiers used
    scored: DataFrame     # every upcoming event with its cohort and score


def library_rows(df: DataFrame, as_of: dt.date, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Past-event sale rows with running % per event name, or ``cfg.event_key`` (W2 then P19).

    Running sums and finals span every row in the lead window, upcoming
    dates included; only then are past events kept (the order matters). Only the columns the library needs are kept.
    """
    rows = known_sales(pacing_rows(df, cfg), as_of, cfg)
    keep = [cfg.event_key, "event_name", "event_date", "days_out", "qty_sold", *tier_keys(cfg), *order_columns(rows, cfg)]
    shares = running_share(rows.select(*dict.fromkeys(keep)), cfg.event_key, cfg, pct_col="hist_cum_pct", one_shuffle=True)
    return past(shares.withColumn("d_bin", bin_floor("days_out", cfg)), as_of)


def _label_column(df: DataFrame) -> str:
    return "event_label" if "event_label" in df.columns else "event_name"


def _has_keys():
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in EVENT_KEYS])


def sold_now(df: DataFrame, as_of: dt.date, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Upcoming events: tickets so far, min days_out, first label."""
    rows = upcoming(known_sales(pacing_rows(df, cfg), as_of, cfg), as_of)
    label = F.col(_label_column(rows))
    by = F.struct(*[F.col(c) for c in order_columns(rows, cfg)])
    agg = (rows.where(_has_keys()).groupBy(*EVENT_KEYS)
           .agg(F.sum("qty_sold").alias("tickets_so_far"), F.min("days_out").alias("days_out"),
                F.min_by(label, F.when(label.isNotNull(), by)).alias("event_label")))
    return agg.withColumn("d_bin", bin_floor("days_out", cfg))


def score(resolved: DataFrame, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Sold-so-far %, typical %, gap, status and label per event."""
    final = F.when(F.col("baseline_final").isNotNull(), F.greatest(F.col("baseline_final"), F.lit(1.0)))
    cum_now = clip(F.lit(100.0) * F.col("tickets_so_far") / final, 0.0, 100.0)
    gap = cum_now - F.col("median_at_d")
    return (resolved.withColumn("_cum_now", cum_now).withColumn("_gap", gap)
            .select(*resolved.columns,
                    F.coalesce(F.col("event_label"), F.col("event_name")).alias("event"),
                    round_half_even("_cum_now", 1).alias("sold_so_far_pct"),
                    round_half_even("median_at_d", 1).alias("typical_at_day_pct"),
                    round_half_even("_gap", 1).alias("gap_pp"),
                    round_to_long("tickets_so_far").alias("ticket_count"),
                    pace_status("_gap", cfg).alias("status"),
                    cohort_label(F.col("tier"), F.col("n"), cfg).alias("cohort")))


def watchlist(df: DataFrame, as_of: dt.date, cfg: PacingConfig = DEFAULT) -> Watchlist:
    """Upcoming events ranked by how far they run behind their cohort (R2).

    Library from past events (tier medians by bin, tier finals), cohort
    resolution per upcoming event, scoring, summary counted before the
    sold-out filter, then the ``watch_top_n`` most-behind rows.
    """
    figures = cohort_figures(library_rows(df, as_of, cfg), cfg, event=cfg.event_key)
    resolved = resolve_figures(sold_now(df, as_of, cfg), figures, EVENT_KEYS, cfg)
    scored = score(resolved, cfg)
    summary = scored.agg(F.count(F.lit(1)).alias("evaluated"),
                         F.count_if(F.col("status") == STATUS_BEHIND).alias("behind"))
    tiers = scored.select("tier").distinct()
    table = (scored.where(F.col("sold_so_far_pct") < cfg.hide_soldout_at)
             .orderBy(F.col("gap_pp").asc_nulls_last(), F.col("days_out").asc(), *[F.col(k).asc() for k in EVENT_KEYS])
             .limit(cfg.watch_top_n)
             .select("event", F.col("days_out").cast("int").alias("days_out"), "sold_so_far_pct", "typical_at_day_pct",
                     "gap_pp", F.col("ticket_count").alias("tickets_so_far"), "status", "cohort"))
    return Watchlist(table, summary, tiers, scored)


def status_counts(table: DataFrame) -> DataFrame:
    """Behind / On pace / Ahead counts of the shown rows, absent -> 0."""
    from ..functions.numeric import normalize_status
    s = normalize_status("status")
    return table.agg(F.count_if(s == STATUS_BEHIND).alias("n_behind"),
                     F.count_if(s == STATUS_ON_PACE).alias("n_on_pace"),
                     F.count_if(s == STATUS_AHEAD).alias("n_ahead"),
                     F.count(s).alias("n_total"))


def checkpoints(table: DataFrame, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Weighted D-30 / D-7 cards over the shown rows.

    Rows within +-tol days of the target, weights max(tickets, 1); a target
    with no rows gives no card. One aggregation handles every target.
    """
    w = F.greatest(F.col("tickets_so_far").cast("double"), F.lit(1.0))
    rows = None
    for day in cfg.checkpoint_days:
        inside = F.col("days_out").between(day - cfg.checkpoint_tol, day + cfg.checkpoint_tol)
        one = table.where(inside).select(F.lit(day).alias("target_day"), "sold_so_far_pct", "typical_at_day_pct",
                                         w.alias("_w"))
        rows = one if rows is None else rows.unionByName(one)
    agg = rows.groupBy("target_day").agg(
        (F.sum(F.col("sold_so_far_pct") * F.col("_w")) / F.sum("_w")).alias("actual"),
        # NaN-like propagation: one missing typical value makes the weighted mean undefined.
        F.when(F.count_if(F.col("typical_at_day_pct").isNull()) == 0,
               F.sum(F.col("typical_at_day_pct") * F.col("_w")) / F.sum("_w")).alias("median"))
    agg = agg.withColumn("gap", F.col("actual") - F.col("median"))
    return agg.select(F.concat(F.lit("D-"), F.col("target_day").cast("string")).alias("label"), "actual", "median",
                      "gap", pace_status("gap", cfg).alias("status"))
