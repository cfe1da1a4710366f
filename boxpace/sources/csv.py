"""CSV and file sources / sinks."""
from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote_plus

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..config import CSV_NULL_TOKENS, REQUIRED_COLUMNS


def clean_header(name: str) -> str:
    """strip -> lower -> spaces to underscores."""
    return str(name).strip().lower().replace(" ", "_")


def normalize_headers(df: DataFrame) -> DataFrame:
    """Rename every column with :func:`clean_header`; two names that collide are an error."""
    names = [clean_header(c) for c in df.columns]
    dup = sorted({n for n in names if names.count(n) > 1})
    if dup:
        raise ValueError(f"Columns collide after header normalisation: {', '.join(dup)}")
    return df.toDF(*names)


def require_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> None:
    """Raise with the sorted list of missing required columns (S3)."""
    missing = sorted(set(required).difference(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")


def null_tokens(df: DataFrame, tokens=CSV_NULL_TOKENS) -> DataFrame:
    """Turn the usual missing-value words of CSV exports into NULL, every string column."""
    toks = [t for t in tokens]
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() == "string":
            c = F.when(c.isin(toks), F.lit(None).cast("string")).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


# sale_seq is the file's place in path order, then the split's in the file, then the row's in its task: so many bits for
# the last two. A file that is not split may use both for its rows.
SPLIT_BITS, ROW_BITS = 16, 26
MAX_FILES = 1 << (63 - SPLIT_BITS - ROW_BITS)
# One row per file is broadcast up to this many files.
BROADCAST_FILES = 100_000


def data_paths(spark: SparkSession, path, suffixes=(".csv",)) -> list[str]:
    """Files to read, in path order: a named file whatever its suffix, a folder's files by suffix (any case).

    One entry per file; file contents are not read.
    """
    paths = [path] if isinstance(path, str) else list(path)
    named = tuple("/" + p.split(":", 1)[-1].strip("/") for p in paths)
    ends = tuple(x.lower() for x in suffixes)
    files = {r["path"] for r in spark.read.format("binaryFile").load(paths).select("path").collect()}
    return sorted(f for f in files if f.lower().endswith(ends) or f.endswith(named))


def first_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, header, plain, header_plain) of every file that has a line with more than blanks: one text pass.

    ``header`` is the first such line. A file is ``plain`` if every quoted cell ends in the line it starts in and there are
    no other quotes, so its lines can be read one by one. Doubled quotes are left out first; then
    whole quoted cells are.
    """
    cells = F.regexp_replace(F.replace("value", F.lit('""'), F.lit("")), r'(^|,)[ \t]*"[^"]*"[ \t]*(?=,|$)', "$1")
    lines = spark.read.text(files).where(F.trim("value") != "").select(
        F.url_decode(F.col("_metadata.file_path")).alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")).alias("at"), "value",
        (~F.contains("value", F.lit('"')) | ~F.contains(cells, F.lit('"'))).alias("plain"))
    return lines.groupBy("file").agg(F.min_by("value", "at").alias("header"), F.bool_and("plain").alias("plain"),
                                     F.min_by("plain", "at").alias("header_plain"))


def header_names(line: str) -> tuple[str, ...]:
    """Cells of a header line; an empty one is named after its place, equal ones get their place as a suffix."""
    cells = next(csv.reader([line]))
    low = [c.lower() for c in cells]
    return tuple(f"_c{i}" if not c else f"{c}{i}" if low.count(c.lower()) > 1 else c for i, c in enumerate(cells))


def read_csv_text(spark: SparkSession, path, suffixes=(".csv",)) -> DataFrame:
    """Header CSV scan with every column as text.

    ``path`` may be a file, a folder or a list of both. Quoted cells may hold line breaks: files that have
    such cells are read whole, one task each, all others in splits. A first pass over the text
    tells them apart and finds all headers (a header with a line break in a name is read by a job of its own). Columns
    are matched by their normalised header: files with one layout
    are read together, and layouts are united by name, so the order of columns may differ and a
    file may lack some. Each row gets ``sale_seq``, which rises with the file's place in path order, then the
    row's place in the file, whatever the sizes of files and the number of cores. A split file may have
    2^16 splits, and a task of splits 2^26 rows.
    """
    files = data_paths(spark, path, suffixes)
    if not files:
        raise FileNotFoundError(f"No data files at {path}")
    if len(files) > MAX_FILES:
        raise ValueError(f"More than {MAX_FILES} data files at {path}")

    def reader(plain):
        return spark.read.option("header", True).option("multiLine", not plain).option("escape", '"').option("mode", "PERMISSIVE")
    place = {unquote_plus(f): i for i, f in enumerate(files)}
    layouts: dict[tuple, list[str]] = {}
    for r in first_lines(spark, files).collect():  # one row per file
        f = files[place[r["file"]]]
        columns = header_names(r["header"]) if r["header_plain"] else tuple(reader(False).csv(f).columns)
        layouts.setdefault((columns, r["plain"]), []).append(f)
    if not layouts:
        return spark.createDataFrame([], "sale_seq long")
    ranks = spark.createDataFrame([(i, f) for f, i in place.items()], "_rank long, _path string")
    if len(files) <= BROADCAST_FILES:
        ranks = F.broadcast(ranks)
    parts = []
    for (columns, plain), group in sorted(layouts.items(), key=lambda x: x[1]):
        schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(columns))])
        rows = reader(plain).schema(schema).csv(sorted(group))
        # All splits of a file but the last have one length, so this is a split's number; the last gets that or more.
        split = F.least(F.expr("_metadata.file_block_start div greatest(_metadata.file_block_length, 1)"), F.lit((1 << SPLIT_BITS) - 1))
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        at = F.shiftleft(split if plain else F.lit(0).cast("long"), ROW_BITS) + row
        rows = rows.select(*rows.columns, F.url_decode(F.col("_metadata.file_path")).alias("_file"), at.alias("_at"))
        rows = rows.join(ranks, F.col("_file") == F.col("_path"))
        seq = F.shiftleft(F.col("_rank"), SPLIT_BITS + ROW_BITS) + F.col("_at")
        named = rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], seq.alias("_seq"))
        parts.append(normalize_headers(named).drop("sale_seq").withColumnRenamed("_seq", "sale_seq"))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return null_tokens(df)


def list_data_files(spark: SparkSession, data_dir: str, suffixes=(".csv",)) -> DataFrame:
    """Files in a folder whose suffix matches (case-insensitive), sorted by path; none for a missing folder.

    Lists through the binary-file source without reading file contents.
    """
    try:
        df = spark.read.format("binaryFile").load(data_dir).select("path", "length", "modificationTime")
    except AnalysisException:
        return spark.createDataFrame([], "path string, length long, modificationTime timestamp")
    hit = reduce(lambda a, b: a | b, [F.lower(F.col("path")).endswith(x.lower()) for x in suffixes])
    return df.where(hit).orderBy("path")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Export with a header row and no index column, in the form :func:`read_csv_text` reads back."""
    (df.write.mode(mode).option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path))


def data_stamp(df: DataFrame) -> DataFrame:
    """One row: first and last sale and the row count."""
    return df.agg(F.min("sale_date").alias("sale_min"), F.max("sale_date").alias("sale_max"),
                  F.count(F.lit(1)).alias("n_rows"))
