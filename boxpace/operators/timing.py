"""Seasons, months and sale-timing heatmaps."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, WEEKDAYS, PacingConfig
from ..functions.lead import (days_out, lead_bucket_closed, lead_bucket_half_open, month_start, season_start_year,
                              weekday_name)
from ..functions.numeric import safe_ratio
from .cumulate import centered_mean3
from .quantiles import null_safe_join


def season_totals(df: DataFrame) -> DataFrame:
    """Tickets per season, NULL season kept, with the start year as sort key."""
    return (df.groupBy("season").agg(F.coalesce(F.sum("qty_sold"), F.lit(0.0)).alias("tickets"))
            .withColumn("start_year", season_start_year("season")))


def monthly_totals(df: DataFrame) -> DataFrame:
    """Tickets per sale month; rows without a sale date are left out."""
    return (df.withColumn("month", month_start("sale_date")).where(F.col("month").isNotNull())
            .groupBy("month").agg(F.coalesce(F.sum("qty_sold"), F.lit(0.0)).alias("qty_sold")))


def monthly_trend(df: DataFrame) -> DataFrame:
    """Monthly totals with the centred three-month mean."""
    return centered_mean3(monthly_totals(df), "month", "qty_sold", "roll3")


def monthly_histogram(df: DataFrame, nbins: int = 30) -> DataFrame:
    """Equal-width histogram of monthly totals between their min and max (A10).

    Bins are [min + i*w, min + (i+1)*w), the last one closed; one row per
    non-empty bin. Works on one row per month.
    """
    m = monthly_totals(df)
    w = Window.partitionBy()
    lo, hi = F.min("qty_sold").over(w), F.max("qty_sold").over(w)
    m = m.withColumn("_lo", lo).withColumn("_w", (hi - lo) / nbins)
    b = F.when(F.col("_w") == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("qty_sold") - F.col("_lo")) / F.col("_w")), F.lit(nbins - 1))).cast("int")
    m = m.withColumn("bin", b)
    return m.groupBy("bin").agg(F.first(F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"),
                                F.first(F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("bin_end"),
                                F.count(F.lit(1)).alias("n_months"))


def sales_heatmap(base: DataFrame, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Share of each closed lead bucket within the sale weekday (A11, F12, W3), by weekday and the bucket's text (T5)."""
    d = base if "days_out" in base.columns else base.withColumn("days_out", days_out())
    top = cfg.lead_buckets[-1][1]
    d = d.where(F.col("days_out").between(0, top))
    g = (d.withColumn("weekday", weekday_name("sale_date")).withColumn("lead_bucket", lead_bucket_closed("days_out", cfg))
         .groupBy("weekday", "lead_bucket").agg(F.coalesce(F.sum("qty_sold"), F.lit(0.0)).alias("qty_sold")))
    tot = F.sum("qty_sold").over(Window.partitionBy("weekday"))
    return (g.select("weekday", "lead_bucket", F.when(tot > 0, F.col("qty_sold") / tot).otherwise(0.0).alias("share"))
            .orderBy(F.array_position(F.array(*[F.lit(x) for x in WEEKDAYS]), F.col("weekday")), "lead_bucket"))


def timing_heatmap(df: DataFrame, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Sale weekday x half-open lead bucket as a share of all tickets.

    Empty unless total > 0, >= heat_min_names distinct names and
    >= heat_min_rows rows. Returns the full 7 x 6 matrix: a bucket without
    sales on a weekday that has sales is 0, a weekday without sales is NULL.
    The gate is one aggregation read as a scalar subquery.
    """
    d = df.withColumn("days_out", days_out()).where(F.col("days_out").between(0, cfg.max_lead))
    d = d.withColumn("weekday", weekday_name("sale_date")).withColumn("lead_bucket", lead_bucket_half_open("days_out", cfg))
    # One aggregation of the sales; the gate, the total and the cells are all derived from it.
    by_name = d.groupBy("weekday", "lead_bucket", "event_name").agg(F.sum("qty_sold").alias("q"), F.count(F.lit(1)).alias("c"))
    stats = by_name.agg(F.struct(F.sum("q").alias("t"), F.count_distinct("event_name").alias("names"),
                                 F.sum("c").alias("rows")).alias("s")).scalar()
    total = stats.getField("t")
    gate = (total > 0) & (stats.getField("names") >= cfg.heat_min_names) & (stats.getField("rows") >= cfg.heat_min_rows)
    # Naming the count too keeps this the same aggregate as the gate's, which Spark then runs once.
    cells = by_name.where(F.col("c") > 0).groupBy("weekday", "lead_bucket").agg(F.sum("q").alias("q"))
    grid = (df.sparkSession.range(1)
            .select(F.explode(F.array(*[F.lit(x) for x in WEEKDAYS])).alias("weekday"))
            .select("weekday", F.explode(F.array(*[F.lit(x) for x in cfg.lead_labels])).alias("lead_bucket")))
    # At most 7 x len(buckets) cells on the broadcast side. Null-safe keys add no filter that would tell the plans apart.
    m = null_safe_join(grid, F.broadcast(cells), ["weekday", "lead_bucket"], "left")
    present = F.max(F.col("q").isNotNull().cast("int")).over(Window.partitionBy("weekday"))
    m = m.withColumn("share", F.when(present == 1, safe_ratio(F.coalesce(F.col("q"), F.lit(0.0)), total)))
    day, bucket = F.array(*[F.lit(x) for x in WEEKDAYS]), F.array(*[F.lit(x) for x in cfg.lead_labels])
    return (m.where(gate).orderBy(F.array_position(day, F.col("weekday")), F.array_position(bucket, F.col("lead_bucket")))
            .select("weekday", "lead_bucket", "share"))
