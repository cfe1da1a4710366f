"""Lead days, bins, clamps, buckets, rounding and status."""
from pyspark.sql import functions as F

from boxpace.config import PacingConfig
from boxpace.functions import lead as L
from boxpace.functions import numeric as N


def test_days_bins_and_clamps(spark):
    # F-early-late: leads -3, 0, 120, 121, 200.
    leads = [-3, 0, 120, 121, 200]
    df = spark.createDataFrame([(d,) for d in leads], "d int")
    rows = df.select("d", L.bin_floor("d").alias("b"), L.lead_clamped("d").alias("c"),
                     F.when(F.col("d") >= 0, L.lead_capped("d")).alias("cap"),
                     L.in_lead_window("d").alias("w")).orderBy("d").collect()
    assert [r["b"] for r in rows] == [-3, 0, 120, 120, 198]
    assert [r["c"] for r in rows] == [0, 0, 120, 120, 120]
    assert [r["cap"] for r in rows] == [None, 0, 120, 120, 120]
    assert [r["w"] for r in rows] == [False, True, True, False, False]


def test_days_out_drops_time_of_day(spark):
    df = spark.createDataFrame([("2020-01-10 23:59:00", "2020-01-09 00:01:00")], "e string, s string")
    assert df.select(L.days_out(F.to_timestamp("e"), F.to_timestamp("s")).alias("d")).first()["d"] == 1


def test_buckets(spark):
    df = spark.createDataFrame([(x,) for x in [None, -1, 0, 7, 8, 14, 15, 61, 90, 91, 120, 121]], "d int")
    rows = df.select(L.lead_bucket_closed("d").alias("a"), L.lead_bucket_half_open("d").alias("b")).collect()
    assert [r["a"] for r in rows] == ["unknown", "<0", "0-7", "0-7", "8-14", "8-14", "15-30", "61-120", "61-120",
                                      "61-120", "61-120", ">120"]
    assert [r["b"] for r in rows] == [None, None, "0–7", "0–7", "8–14", "8–14", "15–30", "61–90", "61–90",
                                      "91–120", "91–120", None]


def test_round_half_even_and_status(spark):
    # F-round: 2.25 -> 2.2 (half-even), 0.25 -> 0.2, 0.35 -> 0.4.
    df = spark.createDataFrame([(2.25,), (0.25,), (0.35,)], "x double")
    assert [r[0] for r in df.select(N.round_half_even("x", 1)).collect()] == [2.2, 0.2, 0.4]
    g = spark.createDataFrame([(-5.0,), (-4.99,), (5.0,), (None,), (float("nan"),)], "g double")
    assert [r[0] for r in g.select(N.pace_status("g", PacingConfig())).collect()] == [
        "Behind", "On pace", "Ahead", "No benchmark", "No benchmark"]


def test_safe_ratio_and_weekday(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(N.safe_ratio("a", "b")).collect()] == [None, 0.25]
    assert [r[0] for r in df.select(N.safe_ratio("a", "b", 0.0)).collect()] == [0.0, 0.25]
    d = spark.createDataFrame([("2000-03-13",)], "s string").select(L.weekday_name(F.to_date("s")).alias("w"))
    r = d.select("w", L.weekday_rank("w").alias("k")).first()
    assert (r["w"], r["k"]) == ("Monday", 0)
