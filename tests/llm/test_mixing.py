import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from boxpace.llm import mixing


@pytest.mark.parametrize("mean", [0.01, 0.5, 1.0, 3.7, 8.0])
def test_table_is_the_distribution(spark, mean):
    got = spark.range(1).select(mixing.poisson_table(F.lit(mean)).alias("t")).first()["t"]
    total, want = 0.0, []
    for k in range(mixing.TABLE):
        total += math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))
        want.append(total)
    assert got == pytest.approx(want, abs=1e-12)
    assert got[-1] == pytest.approx(1.0, abs=1e-12)


def test_draws_follow_the_rate(spark):
    for rate in (0.3, 2.0, 30.0):
        rates = spark.createDataFrame([("s", 1, 1.0, rate), (None, 1, 1.0, 0.0)],
                                      "source string, n long, share double, rate double")
        keyed = spark.range(20_000).select(F.lit("s").alias("_source"), F.xxhash64("id").alias("_key"))
        c = [r["_count"] for r in mixing.replication_counts(keyed, rates, 5).select("_count").collect()]
        mean = sum(c) / len(c)
        var = sum((x - mean) ** 2 for x in c) / len(c)
        assert mean == pytest.approx(rate, abs=4 * math.sqrt(rate / len(c)))
        assert var == pytest.approx(rate, rel=0.08)
        hist = Counter(c)
        for k in range(int(rate), int(rate) + 2):
            p = math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
            assert hist[k] / len(c) == pytest.approx(p, abs=5 * math.sqrt(p / len(c)))


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"),
                                    F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, F.lit(None))
                                    .otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))


def test_shares_and_repeatability(spark, corpus):
    targets = spark.createDataFrame([("hot", 1.0), ("s0", 6.0), ("s1", 1.0), (None, 2.0), ("none such", 5.0), ("s2", -1.0)],
                                    "source string, weight double")
    out = mixing.mix(corpus, targets, factor=2.0).collect()
    n = Counter(r["source"] for r in out)
    for source, share in (("hot", 0.1), ("s0", 0.6), ("s1", 0.1), (None, 0.2)):
        assert n[source] / 18_000 == pytest.approx(share, rel=0.12)
    assert set(n) == {"hot", "s0", "s1", None}
    copies = Counter(r["doc_id"] for r in out)
    assert all(sorted(r["replica"] for r in out if r["doc_id"] == i) == list(range(copies[i])) for i in list(copies)[:20])
    again = mixing.mix(corpus.repartition(7), targets, factor=2.0).collect()
    assert Counter(r["doc_id"] for r in again) == copies
    assert [r["doc_id"] for r in out[:50]] != sorted(r["doc_id"] for r in out[:50])


def test_joined_rates_draw_the_same(spark, corpus, monkeypatch):
    targets = mixing.temperature_targets(corpus, 0.5)
    want = Counter(r["doc_id"] for r in mixing.mix(corpus, targets).collect())
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert Counter(r["doc_id"] for r in mixing.mix(corpus, targets).collect()) == want


def test_edges(edge, clash, empty, edge_rows):
    for df in (edge, clash):
        out = mixing.mix(df, mixing.temperature_targets(df, 1.0), factor=40.0, replica_col="copy_no")
        assert out.columns == [*df.columns, "copy_no"]
        got = out.collect()
        assert {(r["doc_id"], r["text"]) for r in got} == {(r[0], r[1]) for r in edge_rows}
        assert len(got) == pytest.approx(40 * len(edge_rows), rel=0.2)
    replaced = mixing.mix(clash, mixing.temperature_targets(clash, 1.0))
    assert replaced.columns == [*[c for c in clash.columns if c != "replica"], "replica"]
    assert mixing.mix(empty, mixing.temperature_targets(empty)).count() == 0


def test_plan_is_native(corpus):
    plan = mixing.mix(corpus, mixing.temperature_targets(corpus))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
