"""Mixing sources to target weights by Poisson replication (operator 5), column expressions only.

A source with target share w of an output of T documents and n documents of its own
repeats each of them w T / n times on average. Each document draws its count
from a Poisson distribution with that mean: a hash of (seed, document) gives a
uniform number, and the distribution's cumulative sums are inverted at it. Counts
depend on nothing but the document, its source's rate and the seed, so a
recomputed task draws the same ones. Sources never meet in one place; a hot
source is spread like any other.

A Poisson number of mean m is the sum of k independent ones of mean m / k, so rates
above ``CHUNK`` are drawn in parts; each inversion then needs a short table only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_checkpoint

# Largest mean inverted at once, and entries of its table: the rest has a chance below 1e-30.
CHUNK = 8.0
TABLE = 64
# Sources up to which the rate table (under 1 KB a row) is broadcast.
MAX_BROADCAST_SOURCES = 10_000


def poisson_table(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... for a mean of CHUNK at most."""
    p0 = F.exp(-mean)
    start = F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("a"))

    def step(s, k):
        p = s["p"] * mean / k
        c = s["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(s["a"], F.array(c)).alias("a"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TABLE - 1)), start, step, lambda s: s["a"])


def uniform(*key: Column) -> Column:
    """A number in (0, 1) from the key's hash, 53 bits."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") * F.lit(2.0 ** -53) + F.lit(2.0 ** -54)


def source_rates(docs: DataFrame, targets: DataFrame, factor: float = 1.0, source_col: str = "source") -> DataFrame:
    """(source, n, share, rate): documents, normalised target share and mean repetitions of each source.

    ``targets`` has (source, weight); a NULL source is a source of its own. Weights below
    0 or NULL count as 0. A source without target has share 0; targets of sources
    without documents do not count. The output has ``factor`` times the input's documents on average.
    """
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    t = (targets.groupBy(F.col("source").cast("string").alias("_s"))
         .agg(F.sum(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("weight")))
    r = sizes.join(t, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "source", "n", F.coalesce("weight", F.lit(0.0)).alias("w"))
    total = r.agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    share = F.when(total.select("w").scalar() > 0, F.col("w") / total.select("w").scalar()).otherwise(F.lit(0.0))
    return r.select("source", "n", share.alias("share"),
                    (share * F.lit(float(factor)) * total.select("n").scalar() / F.col("n")).alias("rate"))


def temperature_targets(docs: DataFrame, alpha: float = 0.5, source_col: str = "source") -> DataFrame:
    """(source, weight) with weight = documents ** alpha: 1 keeps the mix, 0 makes sources even."""
    return (docs.groupBy(F.col(source_col).cast("string").alias("source"))
            .agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(float(alpha))).alias("weight")))


def replication_counts(keyed: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """Add ``_count``, each row's Poisson draw; ``keyed`` has ``_source`` and the row's hash ``_key``.

    The rates are broadcast where their number is at most MAX_BROADCAST_SOURCES; else
    they are joined like any table, and adaptive execution splits hot sources.
    """
    parts = F.greatest(F.ceil(F.col("rate") / CHUNK), F.lit(1)).cast("int")
    r = rates.where(F.col("rate") > 0).select(F.col("source").alias("_rs"), parts.alias("_k"),
                                              poisson_table(F.col("rate") / parts).alias("_t"))
    r = shared_checkpoint(r)
    if r.count() <= MAX_BROADCAST_SOURCES:
        r = F.broadcast(r)
    j = keyed.join(r, F.col("_source").eqNullSafe(F.col("_rs")))

    def draw(part):
        u = uniform(F.lit(seed), part, F.col("_key"))
        return F.aggregate(F.col("_t"), F.lit(0), lambda a, c: a + F.when(c <= u, 1).otherwise(0))
    count = F.aggregate(F.sequence(F.lit(1), F.col("_k")), F.lit(0), lambda a, part: a + draw(part))
    return j.withColumn("_count", count).drop("_rs", "_k", "_t")


def mix(docs: DataFrame, targets: DataFrame, factor: float = 1.0, seed: int = 17, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", replica_col: str | None = "replica") -> DataFrame:
    """Replicate the rows of ``docs`` to the target shares and shuffle them globally.

    Every column of ``docs`` is returned; ``replica_col`` (from 0) numbers a row's
    copies, unless None. Rows are placed and sorted by a hash of row and replica, so
    any stretch of the output is a random sample of the mix. A row's draw depends on its id and
    text: repeated rows draw alike, and a NULL id or text is a value like others.
    A source without a target (a NULL source can have one) gives no rows, nor does an empty table.
    Columns of ``docs`` may have any name, ``replica_col`` replaces one of its name.
    """
    cols = [c for c in docs.columns if c != replica_col]
    key = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    rates = source_rates(docs, targets, factor, source_col)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), key.alias("_key"),
                        F.col(f"`{source_col}`").cast("string").alias("_source"))
    drawn = replication_counts(keyed, rates, seed).where(F.col("_count") > 0)
    copies = drawn.select("_row", "_key", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)).alias("_rep"))
    order = F.xxhash64(F.lit(seed), F.lit("order"), F.col("_key"), F.col("_rep"))
    spread = copies.withColumn("_o", order).repartition(F.col("_o")).sortWithinPartitions("_o")
    out = [F.col("_row").getField(c).alias(c) for c in cols]
    if replica_col:
        out.append(F.col("_rep").cast("long").alias(replica_col))
    return spread.select(*out)
