"""Time-boxed KPIs."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prep import lit_ts


def kpis(base: DataFrame, watch_summary: DataFrame, as_of: dt.date) -> DataFrame:
    """One row: tickets in the last 30 days and the change against the 30 before,
    average price, open events in the next 30 days and the share behind pace (A23).

    Windows compare timestamps with the as-of midnight (a sale later that day is
    out). All sales figures come from one aggregation; the two watchlist counts
    are scalar subqueries on its one-row summary.
    """
    t = lit_ts(as_of)
    sd, ed = F.col("sale_date"), F.col("event_date")
    last30 = (sd >= lit_ts(as_of - dt.timedelta(days=29))) & (sd <= t)
    prev30 = (sd >= lit_ts(as_of - dt.timedelta(days=59))) & (sd < lit_ts(as_of - dt.timedelta(days=29)))
    open_ev = (ed >= t) & (ed <= lit_ts(as_of + dt.timedelta(days=30)))
    q = F.col("qty_sold")
    has_amount = "amount" in base.columns
    aggs = [F.coalesce(F.sum(F.when(last30, q)), F.lit(0.0)).cast("double").alias("tickets_30d"),
            F.coalesce(F.sum(F.when(prev30, q)), F.lit(0.0)).cast("double").alias("_prev"),
            F.count_distinct(F.when(open_ev, F.col("event_instance"))).alias("open_events")]
    if has_amount:
        aggs.append(F.coalesce(F.sum(F.when(last30, F.col("amount"))), F.lit(0.0)).cast("double").alias("_amount"))
    a = base.agg(*aggs)
    counts = watch_summary.select(F.struct(F.col("evaluated").cast("long").alias("e"),
                                           F.col("behind").cast("long").alias("b")).alias("s")).scalar()
    evaluated, behind = counts.getField("e"), counts.getField("b")
    delta = F.when(F.col("_prev") > 0, (F.col("tickets_30d") - F.col("_prev")) / F.col("_prev"))
    price = (F.when(F.col("tickets_30d") > 0, F.col("_amount") / F.col("tickets_30d")) if has_amount
             else F.lit(None).cast("double"))
    return a.select("tickets_30d", delta.alias("delta_30d"), price.alias("avg_price_30d"),
                    F.col("open_events").cast("long").alias("open_events"),
                    F.when(evaluated > 0, behind / evaluated * 100.0).otherwise(F.lit(0.0)).alias("behind_pct"),
                    F.when(evaluated > 0, F.concat(behind.cast("string"), F.lit(" of "), evaluated.cast("string")))
                    .otherwise(F.lit("–")).alias("behind_detail"))
