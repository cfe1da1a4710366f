"""Stand-in sales tables built from the driver's TPC-H-style parquet files.

These views only give rows in the schema the operators expect (one row per
ticket sale); they do none of the operators' work. Every query of the package
runs on whatever these return, so its work grows with the input tables.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PacingConfig
from ..functions.classify import event_instance, event_label, strip
from ..functions.lead import weekday_name

# Columns that order sales with equal days_out in the stand-in data. The first
# two alone are not unique; all six are.
FIXTURE_ORDER_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")

# Parameters of the registered queries (the stand-in data spans 1995-2001, so
# the application's own period dates would leave one side empty).
FIXTURE_AS_OF = dt.date(2000, 3, 15)
FIXTURE_PRE_END = dt.date(1998, 1, 1)
FIXTURE_POST_START = dt.date(1999, 7, 1)

FIXTURE_CFG = PacingConfig(
    order_key=FIXTURE_ORDER_KEY,
    pre_end=FIXTURE_PRE_END,
    post_start=FIXTURE_POST_START,
    period_split=FIXTURE_POST_START,
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean sale fact: one row per line item, dated by its order.

    Each order's event takes place ten days before the next half-year starts. Orders meet their customers before their line
    items, of which there are many more, and names are looked up last: the line items are shuffled with few short columns.
    """
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    od = F.col("o_orderdate")
    half = F.when(F.month(od) <= 6, F.lit(6)).otherwise(F.lit(12))
    event_day = F.date_sub(F.add_months(F.trunc(od, "YEAR"), half), 10)
    y = F.year(od)
    season = F.concat(y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))
    o = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(p, F.col("l_partkey") == F.col("p_partkey"))
            .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                    od.cast("timestamp_ntz").alias("sale_date"),
                    event_day.cast("timestamp_ntz").alias("event_date"),
                    F.col("p_name").alias("event_name"),
                    F.col("p_type").alias("event_type"),
                    F.col("n_name").alias("venue"),
                    F.col("l_quantity").alias("qty_sold"),
                    F.col("l_extendedprice").alias("amount"),
                    F.col("o_orderpriority").alias("channel"),
                    F.col("c_mktsegment").alias("customer_type"),
                    season.alias("season")))


def with_event_fields(df: DataFrame) -> DataFrame:
    """Add the derived event columns a loaded fact carries (weekday, label, instance)."""
    if "weekday" not in df.columns:
        df = df.withColumn("weekday", weekday_name("event_date"))
    if "event_label" not in df.columns:
        part = "event_part" if "event_part" in df.columns else None
        df = df.withColumn("event_label", event_label("event_name", part))
    if "event_instance" not in df.columns:
        df = df.withColumn("event_instance", event_instance("event_label", "event_date"))
    return df


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean fact with derived event fields."""
    return with_event_fields(sales(spark, sf_dir))


# Raw text table for the ingest path. Fixed lists of the stand-in generator.
RAW_TITLES = ("Symphony Night", "Glee Club", "Opera Gala", "Nutcracker", "Jazz Trio", "Folk Singer-Songwriter",
              "Family Day", "Modern Dance", "Dancers Ball", "Circus Nova", "Lecture Hour", "Film Festival",
              "World Tabla", "Chamber Music", "Music Box", "Popcorn Hour", "Student Recital", "Plain Evening")
RAW_PARTS = ("gala", " Chamber ", "Jazz Extra", "rock-n-roll o'neil", "2nd act", "", "  ", None)
RAW_CATEGORIES = ("Musical", "opera", " film ", "rock-n-roll", "  ", "", None)
# Header spellings of the raw table (normalised by the reader).
RAW_HEADERS = {
    "sale_date": " Sale Date", "event_date": "Event Date", "event_name": "EVENT NAME", "event_part": "Event Part",
    "qty_sold": "Qty Sold", "amount": "Amount", "event_category": "Event Category", "venue": "Venue",
    "channel": "Channel", "customer_type": "Customer Type", "season": "Season",
}


def fact_with_refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean fact with every fifth event's sales turned into refunds."""
    f = fact(spark, sf_dir)
    return f.withColumn("qty_sold", F.when(F.col("l_partkey") % 5 == 0, -F.col("qty_sold")).otherwise(F.col("qty_sold")))


def _pick(values, idx):
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (idx % len(values)).cast("int") + 1)


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean fact turned back into untyped text with dirty values.

    Columns are strings with spreadsheet-style headers, as a CSV export would
    hold them: bad and missing dates, padded names, text quantities with
    refunds and junk, blank venues and mixed category spellings.
    """
    s = sales(spark, sf_dir)
    ok, pk, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    qty_txt = F.col("qty_sold").cast("bigint").cast("string")
    cols = {
        "sale_date": F.when(ok % 101 == 0, F.lit(None).cast("string"))
                      .when(ok % 97 == 0, F.lit("not a date"))
                      .otherwise(F.date_format("sale_date", "yyyy-MM-dd")),
        "event_date": F.when(pk % 89 == 0, F.date_format("event_date", "MM/dd/yyyy"))
                       .otherwise(F.date_format("event_date", "yyyy-MM-dd")),
        "event_name": F.when(ok % 103 == 0, F.lit(None).cast("string"))
                       .otherwise(F.concat(F.lit("  "), _pick(RAW_TITLES, pk), F.lit(" "), F.col("event_name"),
                                           F.lit(" "))),
        "event_part": _pick(RAW_PARTS, sk),
        "qty_sold": F.when(ok % 107 == 0, F.lit("n/a"))
                     .when(ok % 41 == 0, F.concat(F.lit("-"), qty_txt))
                     .otherwise(qty_txt),
        "amount": F.col("amount").cast("string"),
        "event_category": _pick(RAW_CATEGORIES, pk),
        "venue": F.when(sk % 13 == 0, F.lit(None).cast("string"))
                  .when(sk % 11 == 0, F.lit(" "))
                  .otherwise(F.col("venue")),
        "channel": F.col("channel"),
        "customer_type": F.col("customer_type"),
        "season": F.col("season"),
    }
    keys = [F.col(k) for k in FIXTURE_ORDER_KEY]
    return s.select(*keys, *[v.alias(RAW_HEADERS[k]) for k, v in cols.items()])




# Ways to write a date, by the remainder of the order's number.
DATE_TEXTS = ("EEE MMM d yyyy", "MM.dd.yyyy", "d MMMM yyyy", "yyyy-MM-dd'T'HH:mm:ss'+02:00'", "yyyyMMdd", "MM/dd/yyyy hh:mm a",
              "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "'no date'")


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, date_text): order dates at some time of the day, written in several ways."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    when = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), (F.col("o_orderkey") % 24).cast("int"), (F.col("o_orderkey") % 60).cast("int"))
    text = F.lit(None).cast("string")
    for k, form in enumerate(DATE_TEXTS):
        text = F.when(F.col("o_orderkey") % len(DATE_TEXTS) == k, F.date_format(when, form)).otherwise(text)
    return o.select("o_orderkey", text.alias("date_text"))
