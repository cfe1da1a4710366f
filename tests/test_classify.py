"""Classifiers and text builders (F1-F8) against hand-made cases."""
from pyspark.sql import functions as F

from boxpace.functions import classify as C


def _one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(
        expr.alias("x")).first()
    return row["x"]


def test_category_map_cases(spark):
    # The same input -> output pairs the source application's own tests use.
    cases = {"Musical": "Theatre", "opera": "Theatre", "Festival": "Festivals", "Talk": "Talks",
             "concert": "Concerts", "Unknown": "Unknown"}
    for raw, want in cases.items():
        assert _one(spark, C.normalize_category(F.col("c")), c=raw) == want


def test_category_fallback_uses_secondary_value(spark):
    assert _one(spark, C.normalize_category(F.col("c"), F.col("n")), c=None, n="concert") == "Concerts"


def test_category_blank_and_empty(spark):
    assert _one(spark, C.normalize_category(F.col("c"), F.col("n")), c="   ", n="concert") == "Other (Unmapped)"
    # An empty raw value falls through to the fallback.
    assert _one(spark, C.normalize_category(F.col("c"), F.col("n")), c="", n="Big Film Night") == "Film"
    assert _one(spark, C.normalize_category(F.col("c")), c="rock-n-roll") == "Rock-N-Roll"


def test_title_case_after_any_non_letter(spark):
    got = _one(spark, C.title_case(F.col("s")), s="rock-n-roll o'neil the 2nd act")
    assert got == "rock-n-roll o'neil the 2nd act".title()
    assert _one(spark, C.title_case(F.col("s")), s="CHAMBER music") == "Chamber Music"


def test_event_type_ladder(spark):
    et = C.event_type(F.col("p"), F.col("n"), F.col("c"))
    assert _one(spark, et, p=" gala ", n="x", c="Theatre") == "Gala"
    assert _one(spark, et, p="Jazz Extra", n="x", c="Theatre") == "Jazz"
    assert _one(spark, et, p="2nd act", n="x", c="Theatre") == "2Nd Act"
    assert _one(spark, et, p="  ", n="Glee Club night", c="Theatre") == "Choir / Vocal"
    assert _one(spark, et, p=None, n="Plain Evening", c=" Talks ") == "Talks"
    assert _one(spark, et, p=None, n="Plain Evening", c=None) == "Other"


def test_collab_categories_first_match(spark):
    cc = C.collab_category(F.col("n"))
    assert _one(spark, cc, n="Nutcracker Suite") == "Theatre"
    assert _one(spark, cc, n="Chamber Music") == "Music—Classical"
    assert _one(spark, cc, n="Modern Dance") == "Dance"
    assert _one(spark, cc, n="Dancers Ball") == "Other (Unmapped)"
    assert _one(spark, cc, n="Music Box") == "Music"
    assert _one(spark, cc, n="World Tabla") == "World/Global"


def test_label_and_instance(spark):
    df = spark.createDataFrame([("  Opera Gala ", " matinee ")], "n string, p string")
    df = df.withColumn("event_date", F.to_timestamp(F.lit("2020-05-01")))
    r = df.select(C.event_label(F.col("n"), F.col("p")).alias("l")).withColumn(
        "i", C.event_instance("l", F.to_timestamp(F.lit("2020-05-01")))).first()
    assert r["l"] == "Opera Gala – matinee"
    assert r["i"] == "opera gala – matinee|2020-05-01"


def test_category_totals_by_name(spark):
    """Category totals sum the sales of a name before its name is looked at."""
    from boxpace.operators.compare import category_totals, top_categories_pre_post
    import datetime as dt
    day = dt.datetime(2019, 1, 1)
    df = spark.createDataFrame([(day, n, q) for n, q in [("Jazz A", 1.0), ("Jazz A", 2.0), ("Jazz B", None), ("Circus", -1.0), ("Zzz", 4.0), (None, 5.0)]],
                               "sale_date timestamp_ntz, event_name string, qty_sold double")
    totals = category_totals(df)
    assert {tuple(r) for r in totals.collect()} == {("Music—Jazz", 3.0), ("Circus Arts", -1.0)}
    assert [tuple(r) for r in top_categories_pre_post(df).collect()] == [("Music—Jazz", 3.0, 0.0), ("Circus Arts", -1.0, 0.0)]
