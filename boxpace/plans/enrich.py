"""Raw text to clean sale fact (R1: S2-S3, P1-P6, F1-F9)."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import (CENTURY_PIVOT, DATE_MONTH, DATE_WEEKDAY, DEFAULT, MONTHS, NUMBER_SHAPE, NUMERIC_COLUMNS,
                      PacingConfig)
from ..functions.classify import event_instance, event_label, event_type_of, normalize_category, strip
from ..functions.lead import weekday_name
from ..sources.csv import normalize_headers, read_csv_text, require_columns


def to_number(c) -> Column:
    """Text to double, anything that is not a plain decimal number -> NULL."""
    c = strip((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.when(c.rlike(NUMBER_SHAPE), c.try_cast("double"))


def _bind(value: Column, fn) -> Column:
    """``fn`` of ``value``, which is evaluated once however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), 0)


def _date_of(day: Column) -> Column:
    """A date from a text's numbers and names, as a struct (y, m, d); NULL fields where the text has no reading.

    Words that are no month or weekday, and any count of numbers but a date's, have none.
    With a month's name the other two numbers are day and year; without one a first number of four digits (or
    over 31) is the year and month and day follow, otherwise month, day and year, or day, month and year where the first number
    can't be a month. Where the reading's month can't be one but its day can, they are exchanged. Eight digits are year, month and day.
    """
    text = F.regexp_replace(F.regexp_replace(F.lower(day), r"(?<=\d)(st|nd|rd|th)\b", ""), DATE_WEEKDAY, " ")
    name = F.regexp_extract(text, DATE_MONTH, 1)
    rest = F.trim(F.regexp_replace(F.regexp_replace(text, DATE_MONTH, " "), r"[-/.,\s]+", " "))
    packed = F.regexp_replace(rest, r"^(\d{4})(\d{2})(\d{2})$", "$1 $2 $3")

    def read(parts):
        # try_cast also tells words, signs and numbers that are far too long.
        n = [F.get(parts, k).try_cast("int") for k in range(3)]
        wide = [F.length(F.get(parts, k)) for k in range(3)]

        def year(k):
            return F.when(wide[k] > 2, n[k]).when(n[k] >= CENTURY_PIVOT, n[k] + 1900).otherwise(n[k] + 2000)

        def fields(y, m, d):
            return F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))
        month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name)
        swapped = (n[1] > 12) & (n[2] <= 12)
        year_first = (wide[0] > 2) | (n[0] > 31)
        return (F.when((name != "") & (F.size(parts) == 2), F.when(
                    (wide[0] > 2) | (n[0] > 31), fields(year(0), month, n[1])).otherwise(fields(year(1), month, n[0])))
                .when((name != "") | (F.size(parts) != 3), F.lit(None))
                .when(year_first, F.when(swapped, fields(year(0), n[2], n[1])).otherwise(fields(year(0), n[1], n[2])))
                .when((n[0] > 12) & (n[1] <= 12), fields(year(2), n[1], n[0])).otherwise(fields(year(2), n[0], n[1])))
    return _bind(F.split(packed, " "), read)


def to_timestamp(c) -> Column:
    """Text to timestamp, else NULL.

    A date (:func:`_date_of`: numbers, month and weekday names, any common separator), alone or followed by a
    time of day: hours and minutes, with seconds, fractions or AM / PM. The wall clock counts: a zone or offset at the end
    is read and left out. Plain ISO dates, the common case, are parsed at once.
    """
    txt = strip((F.col(c) if isinstance(c, str) else c).cast("string"))

    def combine(day, time):
        hour = F.regexp_extract(time, r"^(\d+)", 1).try_cast("int")
        minute = F.coalesce(F.regexp_extract(time, r"^\d+:(\d+)", 1).try_cast("int"), F.lit(0))
        second = F.coalesce(F.regexp_extract(time, r"^\d+:\d+:([\d.]+)", 1).try_cast("decimal(16,6)"),
                            F.lit(0).cast("decimal(16,6)"))
        half = F.lower(F.regexp_extract(time, r"([AaPp])\.?[Mm]", 1))
        h24 = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
        ok = (time == "") | ((h24 < 24) & (minute < 60) & (second < 60))
        plain = time == ""
        return _bind(_date_of(day), lambda x: F.when(ok, F.try_make_timestamp_ntz(
            x["y"], x["m"], x["d"], F.when(plain, 0).otherwise(h24), F.when(plain, 0).otherwise(minute),
            F.when(plain, F.lit(0).cast("decimal(16,6)")).otherwise(second))))

    def split(clean):
        time = F.regexp_extract(clean, r"[ ,](\d{1,2}(:\d{2}(:\d{2}(\.\d+)?)?( ?[AaPp]\.?[Mm]\.?)?| ?[AaPp]\.?[Mm]\.?))$", 1)
        return _bind(time, lambda tm: _bind(
            F.when(tm == "", clean).otherwise(F.substring(clean, F.lit(1), F.length(clean) - F.length(tm) - 1)),
            lambda day: combine(day, tm)))
    clean = F.regexp_replace(F.regexp_replace(txt, r"(?<=\d)T(?=\d)", " "),
                             r" ?(Z|UTC|GMT)?( ?(?<=\d:\d{2}|:\d{2}\.\d{1,9}|Z|UTC|GMT| )[+-]\d{2}:?(\d{2})?)?( ?\([A-Z]{2,5}\))?$", "")
    iso = txt.try_cast("date").cast("timestamp_ntz")
    return F.when(txt.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso).when(txt.rlike(r"\d"), _bind(clean, split))


def venue_default(c=None) -> Column:
    """NULL or blank venue -> 'Unknown', else trimmed."""
    if c is None:
        return F.lit("Unknown")
    v = strip(F.col(c) if isinstance(c, str) else c)
    return F.when(v.isNull() | (v == ""), F.lit("Unknown")).otherwise(v)


def enrich(raw: DataFrame, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Normalise headers, check, coerce, drop incomplete rows, classify and label.

    Every step is a column expression; extra columns stay in the frame.
    """
    df = normalize_headers(raw)
    require_columns(df)
    for c in NUMERIC_COLUMNS:
        if c in df.columns:
            df = df.withColumn(c, to_number(c))
    df = df.withColumn("sale_date", to_timestamp("sale_date")).withColumn("event_date", to_timestamp("event_date"))
    df = df.na.drop(subset=["sale_date", "event_date", "event_name", "qty_sold"])
    df = df.withColumn("event_name", strip(F.col("event_name")))
    df = df.withColumn("qty_sold", F.coalesce(F.col("qty_sold"), F.lit(0.0)))
    if "event_category" in df.columns:
        df = df.withColumn("event_category", normalize_category(F.col("event_category"), None, cfg))
    else:
        df = df.withColumn("event_category", normalize_category(None, F.col("event_name"), cfg))
    has_part = "event_part" in df.columns
    # Texts that the ladder looks at again and again get columns of their own, which are built once per row.
    texts = {"_name_key": F.lower("event_name")} | ({"_part": strip("event_part")} if has_part else {})
    df = df.withColumns(texts)
    if has_part:
        df = df.withColumn("_part_key", F.lower("_part"))
    df = df.withColumn("event_type", event_type_of("_part" if has_part else None, "_part_key" if has_part else None, "_name_key",
                                                   "event_category", cfg))
    df = df.withColumn("event_label", event_label("event_name", "_part" if has_part else None)).drop("_name_key", "_part", "_part_key")
    df = df.withColumn("event_instance", event_instance("event_label", "event_date"))
    df = df.withColumn("weekday", weekday_name("event_date"))
    df = df.withColumn("venue", venue_default("venue" if "venue" in df.columns else None))
    return df


def dropped_rows(raw: DataFrame) -> DataFrame:
    """One row: how many rows of ``raw`` each rule of :func:`enrich` drops, and how many it keeps.

    A row that several rules drop counts for each of them.
    """
    df = normalize_headers(raw)
    require_columns(df)
    checks = {"sale_date": to_timestamp("sale_date"), "event_date": to_timestamp("event_date"),
              "event_name": F.col("event_name"), "qty_sold": to_number("qty_sold")}
    flags = df.select(*[c.isNull().alias(k) for k, c in checks.items()])
    kept = F.lit(True)
    for k in checks:
        kept = kept & ~F.col(k)
    return flags.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(k)).alias(f"bad_{k}") for k in checks],
                     F.count_if(kept).alias("n_kept"))


def load_or_report(spark: SparkSession, path, cfg: PacingConfig = DEFAULT) -> tuple[DataFrame | None, str | None]:
    """(fact, None), or (None, message) where the data can't be read or lacks required columns."""
    try:
        return load_sales(spark, path, cfg), None
    except (AnalysisException, OSError, ValueError) as e:
        return None, str(e)


def load_sales(spark: SparkSession, path, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """CSV file(s) or folder to the clean fact (S1 + R1)."""
    return enrich(read_csv_text(spark, path), cfg)
