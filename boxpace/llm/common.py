"""Shared helpers of the corpus operators."""
from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Task functions of this subpackage travel by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

# Bytes of one Arrow batch handed to a Python worker. Row counts alone do not
# bound a batch when some texts are very long.
ARROW_BATCH_BYTES = 8 << 20
# The white space of all word and line contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches of this session by bytes, unless the session is stricter already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None) or "2147483647"
    if not now.isdigit() or int(now) > ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of ``docs``; a NULL text becomes the empty text.

    Every other column is left behind, so extra columns can't clash with what
    an operator adds.
    """
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only, whatever the session's collation or locale."""
    return F.translate(c, UPPER, UPPER.lower())


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder all executors share and read it back.

    The folder is the session's ``spark.checkpoint.dir``; one is set only where
    it is unset, as in tests. Later jobs read the written rows, so a lost
    executor recomputes nothing before this point.
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(docs: DataFrame, value: Callable, value_type: str, text_col: str = "text") -> DataFrame:
    """(row, value): whole rows as a struct, with ``value(text)`` computed for each in Arrow batches.

    ``value`` gets the text as a string, a NULL one as the empty text; ``value`` is made by calling
    the function given once per task, so it can build what it needs there. Rows travel inside
    the struct, so their columns may have any name.
    """
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    kind = StructField("value", _parse_datatype_string(value_type))

    def run(batches):
        import pyarrow as pa
        one = value()
        for b in batches:
            texts = b.column(0).flatten()[at].to_pylist()
            out = pa.array([one(t or "") for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=["row", "value"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, StructType([StructField("row", docs.schema), kind]))
