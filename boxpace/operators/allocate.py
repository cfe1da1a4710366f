"""Proportional integer allocation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, PacingConfig
from .cumulate import order_slot


def allocate(df: DataFrame, group_cols: list[str], weight: str, total: str | None, order_cols: list[str],
             out: str = "alloc", cfg: PacingConfig = DEFAULT, total_of: str | None = None) -> DataFrame:
    """Split each group's integer total over its rows in proportion to ``weight``.

    The total is the group's ``total`` column or, with ``total_of``, the sum of that column, then added as ``total_of_sum``.
    Every row gets floor(weight / sum(weight) * total); the remainder goes one
    unit at a time to the first rows in ``order_cols`` order, so the parts add
    up to the total. Integral weights use exact integer arithmetic.

    Equal rows are counted first: grouping columns are never pruned, so every later step reads that one shuffle and ``df``
    is read once. A row's rank comes from two levels: rows in earlier slots of ``cfg.order_span`` values of the first order
    column, and a window inside the slot, so no task needs all rows of a group.
    """
    is_int = dict(df.dtypes)[weight] in ("bigint", "int", "smallint", "tinyint")
    base = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_slot", order_slot(df, order_cols[0], cfg))
    copies = F.col("_copies")
    whole: Column = F.sum(F.col(total_of) * copies) if total_of else F.max(F.col(total))
    sums = base.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)]).agg(
        F.sum(F.col(weight) * copies).alias("_wsum"), whole.cast("bigint").alias("_tot"))
    here = [F.col(c) == F.col(f"_g{i}") for i, c in enumerate(group_cols)]
    d = base.join(sums, here).drop(*[f"_g{i}" for i in range(len(group_cols))])
    if is_int:
        # floor(w * T / W) in exact integer arithmetic (weights and totals are non-negative).
        part = F.when(F.col("_wsum") != 0, F.expr(f"(CAST(`{weight}` AS BIGINT) * _tot) div _wsum"))
    else:
        part = F.floor(F.col(weight) / F.col("_wsum") * F.col("_tot")).cast("bigint")
    d = d.withColumn("_part", part)

    slots = d.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)], F.col("_slot").alias("_s")).agg(
        F.sum(copies).alias("_rows"), F.sum(F.col("_part") * copies).alias("_given"), F.max("_tot").alias("_t"))
    group = Window.partitionBy(*[f"_g{i}" for i in range(len(group_cols))])
    earlier = group.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(*[f"_g{i}" for i in range(len(group_cols))], "_s",
                         (F.max("_t").over(group) - F.sum("_given").over(group) - F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
                         .alias("_left"))  # units left for the slot and all after it
    inside = (Window.partitionBy(*group_cols, "_slot").orderBy(*[F.col(c).asc() for c in order_cols])
              .rowsBetween(Window.unboundedPreceding, 0))
    ranked = d.withColumn("_rank", F.sum("_copies").over(inside) - copies)
    ranked = ranked.join(slots, [*here, F.col("_slot") == F.col("_s")])
    # Equal rows take the next ranks in turn.
    each = ranked.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    got = F.col("_part") + F.when(F.col("_rank") + F.col("_copy") <= F.col("_left"), 1).otherwise(0)
    extra = [F.col("_tot").alias(f"{total_of}_sum")] if total_of else []
    return each.select(*df.columns, *extra, got.alias(out))
