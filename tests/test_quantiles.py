"""Exact group quantiles by narrowing equal Spark's percentile, weighted and not, whatever the distribution."""
import random

import pytest
from pyspark.sql import functions as F

from boxpace.config import PacingConfig
from boxpace.operators.quantiles import group_quantiles

PROBS = {"p0": 0.0, "p25": 0.25, "med": 0.5, "p75": 0.75, "p90": 0.9, "p100": 1.0}


def _data(spark):
    rnd, rows = random.Random(7), []
    for g in range(40):
        for _ in range([0, 1, 2, 3, 50, 400][g % 6]):
            v = rnd.choice([None, float(rnd.randint(-5, 5)), rnd.random() * 100, -rnd.random() * 1e-9, rnd.random() * 1e300,
                            50 + rnd.random() * 1e-7, float("inf") if g == 5 else 1.0, float("nan") if g in (10, 11) else 2.0])
            rows.append((f"g{g}" if g % 7 else None, "k" if g % 3 else None, v, rnd.randint(1, 4)))
        rows.append((f"g{g}" if g % 7 else None, "k" if g % 3 else None, None, 2))
    return spark.createDataFrame(rows, "a string, b string, v double, w int").repartition(5)


@pytest.mark.parametrize("weight", [None, "w"])
def test_equal_to_percentile(spark, weight):
    df = _data(spark)
    w = F.col(weight) if weight else F.lit(1)
    got = group_quantiles(df, ["a", "b"], "v", PROBS, weight=weight, n="n", n_rows="rows").collect()
    want = df.groupBy("a", "b").agg(*[F.percentile("v", F.lit(p), w).alias(k) for k, p in PROBS.items()],
                                    F.sum(F.when(F.col("v").isNotNull(), w).otherwise(0)).alias("n"), F.sum(w).alias("rows"))
    assert sorted(map(repr, got)) == sorted(map(repr, want.collect()))


def test_a_group_of_a_million_distinct_values(spark):
    """Also values so close that most share one bucket of the scale."""
    n = 1_000_000
    near = F.lit(70.0) + F.col("id") * 1e-10
    df = spark.range(n).select(F.explode(F.array(
        F.struct(F.lit("wide").alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("v")),
        F.struct(F.lit("near").alias("g"), near.alias("v")))).alias("r")).select("r.*")
    got = {r["g"]: (r["m"], r["q"], r["n"]) for r in group_quantiles(df, ["g"], "v", {"m": 0.5, "q": 0.9}, n="n").collect()}
    assert got["wide"] == (499_999.5, pytest.approx(899_999.1), n)
    assert got["near"] == (pytest.approx(70 + 499_999.5e-10, abs=1e-13), pytest.approx(70 + 899_999.1e-10, abs=1e-13), n)


def test_empty_input_and_approximate_mode(spark):
    df = _data(spark)
    assert group_quantiles(df.where("false"), ["a"], "v", PROBS).collect() == []
    small = spark.createDataFrame([("x", float(i)) for i in range(101)], "a string, v double")
    r = group_quantiles(small, ["a"], "v", {"m": 0.5}, PacingConfig(approx_accuracy=1000), n="n").first()
    assert (r["m"], r["n"]) == (50.0, 101)


def _shuffled(plan):
    """Records that the shuffles of an executed plan wrote, each shuffle once."""
    name, found = plan.getClass().getSimpleName(), {}
    if name == "AdaptiveSparkPlanExec":
        return _shuffled(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _shuffled(plan.plan())
    if name == "ReusedExchangeExec":
        return found
    if name == "ShuffleExchangeExec":
        found[plan.id()] = plan.metrics().get("shuffleRecordsWritten").get().value()
    children = plan.children()
    for i in range(children.size()):
        found |= _shuffled(children.apply(i))
    return found


def test_only_counts_and_values_near_a_rank_are_shuffled(spark):
    """All values once, twice and three times each were shuffled before; now coarse counts and the values of a few buckets."""
    n, groups = 400_000, 4
    df = spark.range(0, n, 1, 4).select((F.col("id") % groups).alias("g"), ((F.col("id") * 7919) % n / n * 100).alias("v"))
    q = group_quantiles(df, ["g"], "v", {"m": 0.5}, n="n")
    q.write.format("noop").mode("overwrite").save()
    assert {r["n"] for r in q.collect()} == {n // groups}
    assert 0 < sum(_shuffled(q._jdf.queryExecution().executedPlan()).values()) < n / 4
