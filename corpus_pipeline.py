"""Training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return
the columns of ``documents``. ``run`` writes every stage's result as Parquet in the shared
checkpoint folder and gives the reread table to the next one, so a lost executor costs one stage's
tasks at most.
"""
from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxpace.llm import bpe, jaccard, lines, mixing, toxicity
from boxpace.llm.catalog import BPE_FILE
from boxpace.llm.common import sha256_hex, table
from boxpace.session import ensure_checkpoint_dir

# SQL can't express the classifier or the Poisson draws; tests compare with a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a machine fitted to the labels scores below 0.3.

    A NULL or empty text scores the bias alone; repeated rows are scored each; an empty table gives no rows.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), 0.3)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long lines that five or more of them share, but for the last holder.

    A NULL or empty text is one empty line and stays; rows with one id hold a line together; no row goes.
    """
    return lines.rewrite_lines(docs, min_chars=40, min_docs=5)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 80 % of shingles or more, the one with the smallest id.

    Rows without words link with nothing and all stay; of rows that repeat an id and a text one stays.
    """
    return jaccard.keep_first(docs, pct=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to square-root shares of their sources, shuffled globally.

    A NULL source is a source of its own; the draw goes by id and text, so repeated rows have one count.
    """
    return mixing.mix(docs, mixing.temperature_targets(docs, 0.5), replica_col=None)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the digest of the bytes they decode to; NULL and empty texts have no ids."""
    enc = bpe.encode(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, with_decoded=True)
    return enc.select("doc_id", "n_tokens", "token_ids", sha256_hex(F.col("decoded")).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_near),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
