"""Group quantiles with linear interpolation (pandas ``median`` / ``quantile``).

``group_quantiles`` is the only place percentiles are computed. It selects the values at the wanted ranks by
narrowing twice and never holds a group in one task:

1. values fall into coarse buckets of a fixed scale that never falls with the value; the buckets' counts, combined before
   the shuffle and summed along the scale, tell exactly which buckets hold the wanted ranks;
2. only values of these buckets are shuffled, as (group, value) counts. A bitmap of fixed size tells them: a mark that two
   buckets share lets some values more through, which the joins with the wanted buckets then drop;
3. fine buckets narrow them once more, so only values next to a rank are sorted, and the values at the ranks are picked.

Counts decide, not a sketch: every rank is found, whatever the distribution. The scale is logarithmic with so
many buckets to a factor of e (above 1): a fine one is at most 1/65,536 wide relative to its values.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, PacingConfig

COARSE_PER_E = 1 << 8
FINE_PER_E = 1 << 16
# Bits of the bitmap of wanted buckets: 256 KB.
MARKS = 1 << 21


def null_safe_join(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Join on equal ``cols``, where NULL equals NULL; the right side's copies are dropped."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in cols],
                     *[F.col(c) for c in right.columns if c not in cols])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in cols], F.lit(True))
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in cols])


def value_bucket(v: Column, per_e: int) -> Column:
    """Place of a double on the fixed scale; NaN, which sorts last, has the last one, NULL none."""
    place = F.floor(F.signum(v) * F.least(F.log1p(F.abs(v)), F.lit(1000.0)) * per_e)
    return F.when(F.isnan(v), F.lit(1 << 62)).otherwise(place)


def _mark(cols: list) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(MARKS))


def _marked_rows(rows: DataFrame, wanted: DataFrame, cols: list[str], places: list[list[Column]] | None = None) -> DataFrame:
    """The ``rows`` whose ``cols``, or one of ``places``, have the mark of a row of ``wanted``; the marks are one array of
    ``MARKS`` bits, whatever their number."""
    place = wanted.select(_mark(cols).alias("_m")).select(
        F.floor(F.col("_m") / 64).cast("int").alias("_word"), F.expr("shiftleft(1L, cast(_m % 64 as int))").alias("_bit"))
    none = rows.sparkSession.range(0, MARKS // 64, 1, 1).select(F.col("id").cast("int").alias("_word"), F.lit(0).cast("long").alias("_bit"))
    words = place.unionByName(none).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    bitmap = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("_word", "_bits"))), lambda x: x["_bits"]).alias("_marks"))
    marks = [_mark(p) for p in places or [cols]]
    hits = [F.getbit(F.get("_marks", F.floor(m / 64).cast("int")), (m % 64).cast("int")) == 1 for m in marks]
    return rows.join(F.broadcast(bitmap), reduce(lambda a, b: a | b, hits)).drop("_marks")


def _holding(buckets: DataFrame, ranks: list[Column], within: list[str], place: str, real: Column) -> DataFrame:
    """Buckets that hold one of ``ranks`` along ``place`` within each group ``within`` (all of a group without values).

    ``_want`` has the ranks counted from the bucket's first value, NULL for those elsewhere.
    """
    upto = Window.partitionBy(*within).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(real).over(upto)
    b = buckets.withColumn("_end", end).withColumn("_start", F.col("_end") - real)
    inside = F.array(*[F.when((r >= F.col("_start")) & (r < F.col("_end")), r - F.col("_start")) for r in ranks])
    return (b.withColumn("_want", inside).where(F.exists("_want", lambda x: x.isNotNull()) | (F.col("_n") == 0))
            .drop("_start", "_end"))


def group_quantiles(df: DataFrame, group_cols: list[str], value: str, probs: dict[str, float],
                    cfg: PacingConfig = DEFAULT, weight: str | None = None, n: str | None = None,
                    n_rows: str | None = None) -> DataFrame:
    """One row per group: each named quantile of ``value``, NULLs skipped, NaN the largest value.

    Linear interpolation between the closest ranks, as Spark's ``percentile``; a group without values has NULL
    quantiles. A row counts ``weight`` times (a whole number; one without it). ``n`` and ``n_rows`` name columns for the
    count of values and of rows. Exact, unless ``cfg.approx_accuracy`` > 0 takes ``percentile_approx`` (unweighted).
    """
    v = F.col(value).cast("double")
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    names, ps = list(probs), [float(p) for p in probs.values()]
    counts = {k: c for k, c in ((n, F.sum(F.when(v.isNotNull(), w).otherwise(0))), (n_rows, F.sum(w))) if k}
    if cfg.approx_accuracy and not weight:
        aggs = [F.percentile_approx(v, p, cfg.approx_accuracy).cast("double").alias(k) for k, p in zip(names, ps)]
        return df.groupBy(*group_cols).agg(*aggs, *[c.alias(k) for k, c in counts.items()])
    rows = df.select(*group_cols, v.alias("_v"), w.alias("_c")).withColumn("_z", value_bucket(F.col("_v"), COARSE_PER_E))
    return quantiles_of_buckets(rows, rows.groupBy(*group_cols, "_z").agg(F.sum("_c").alias("_c")), group_cols, probs, n, n_rows)


def quantiles_of_buckets(rows: DataFrame, buckets: DataFrame, group_cols: list[str], probs: dict[str, float], n: str | None = None,
                         n_rows: str | None = None, expand: Callable[[DataFrame], DataFrame] | None = None,
                         places: list[list[Column]] | None = None) -> DataFrame:
    """Quantiles of the (group, ``_z``, ``_v``, ``_c``) ``rows``: a value, its count and coarse bucket, which ``buckets`` counts.

    With ``expand`` a row stands for several groups and is turned into one row for each only if one of its ``places``, the
    (group, ``_z``) of each as columns of the row, may hold a rank.
    """
    g, names, ps = group_cols, list(probs), [float(p) for p in probs.values()]
    real = F.when(F.col("_z").isNotNull(), F.col("_c")).otherwise(0)
    whole = Window.partitionBy(*g)
    buckets = buckets.select(*g, "_z", "_c", F.sum(real).over(whole).alias("_n"), F.sum("_c").over(whole).alias("_rows"))
    at = [F.lit(p) * (F.col("_n") - 1) for p in ps]
    ranks = [r for a in at for r in (F.floor(a), F.ceil(a))]  # of each quantile the value at or below, and at or above
    wanted = _holding(buckets, ranks, g, "_z", real).drop("_c")

    coarse = [*g, "_z"]
    near = _marked_rows(rows, wanted, coarse, places)
    if expand:
        near = _marked_rows(expand(near), wanted, coarse)
    cells = (near.groupBy(*coarse, "_v").agg(F.sum("_c").alias("_c"))
             .withColumn("_f", value_bucket(F.col("_v"), FINE_PER_E)))
    fine = null_safe_join(cells.groupBy(*coarse, "_f").agg(F.sum("_c").alias("_c")),
                          wanted.withColumnRenamed("_want", "_ranks"), coarse)
    fine = _holding(fine, [F.col("_ranks")[k] for k in range(len(ranks))], coarse, "_f", F.col("_c"))

    found = null_safe_join(cells, fine.select(*coarse, "_f", "_n", "_rows", "_want"), [*coarse, "_f"])
    inside = Window.partitionBy(*coarse, "_f").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("_hi", F.sum("_c").over(inside))
    picked = []
    for k in range(2 * len(ps)):
        r = F.col("_want")[k]
        picked.append(F.max(F.when((r >= F.col("_hi") - F.col("_c")) & (r < F.col("_hi")), F.col("_v"))).alias(f"_v{k}"))
    out = found.groupBy(*g).agg(F.max("_n").alias("_n"), F.max("_rows").alias("_rows"), *picked)
    cols = []
    for k, (name, a) in enumerate(zip(names, at)):
        lo, hi = F.col(f"_v{2 * k}"), F.col(f"_v{2 * k + 1}")
        between = (F.ceil(a) - a) * lo + (a - F.floor(a)) * hi
        cols.append(F.when(F.ceil(a) == F.floor(a), lo).otherwise(between).alias(name))
    return out.select(*g, *cols, *[F.col(c).alias(k) for k, c in ((n, "_n"), (n_rows, "_rows")) if k])
