"""Hashed terms of texts and the bounded training sample, shared by the two classifiers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts


def term_hashes(terms) -> "np.ndarray":  # noqa: F821
    """Sorted distinct 32-bit hashes of terms."""
    import zlib

    import numpy as np
    return np.unique(np.fromiter((zlib.crc32(t.encode("utf-8", "replace")) for t in terms), dtype=np.uint32))


def word_terms(text: str) -> set[str]:
    """Distinct lower-cased words of letters, and the first four letters of the longer ones."""
    import re
    words = set(re.findall(r"[^\W\d_]+", text.lower()))
    return words | {"^" + w[:4] for w in words if len(w) > 4}


def held_out(id_col: str) -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; False for a NULL id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, target: Column, max_rows: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, target, text) of at most ``max_rows`` labelled ids that are not held out.

    Ids come in the order of their hash, so the sample is the same at every run. Rows
    without id or target are left out.
    """
    picked = (labels.select(F.col(id_col).cast("long").alias("_id"), target.cast("int").alias("target"))
              .where(F.col("_id").isNotNull() & F.col("target").isNotNull() & ~held_out("_id"))
              .orderBy(F.xxhash64("_id"), "_id", "target").limit(max_rows))
    # At most max_rows ids of 12 bytes.
    return texts(docs, id_col, text_col).join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).drop("_id")


def train_on_one(sample: DataFrame, terms, fit) -> bytes:
    """``fit([(target, hashes)]) -> bytes`` over the sample's hashed terms, in one task.

    The terms are hashed where the texts are; only 32-bit numbers of the bounded
    sample meet in the task that trains, in the order of ids.
    """
    def hash_texts(batches):
        import pyarrow as pa
        for b in batches:
            out = [term_hashes(terms(t)).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())],
                                             names=["doc_id", "target", "terms"])

    def train(batches):
        import numpy as np
        import pyarrow as pa
        rows = []
        for b in batches:
            rows += [(y, np.frombuffer(t, dtype=np.uint32)) for y, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_pydict({"model": pa.array([fit(rows)], pa.binary())})
    hashed = sample.select("doc_id", "target", "text").mapInArrow(hash_texts, "doc_id long, target int, terms binary")
    one = hashed.repartition(1).sortWithinPartitions("doc_id", "target", "terms").mapInArrow(train, "model binary")
    row = one.first()
    return bytes(row["model"]) if row else fit([])  # no labelled row


def sparse_rows(rows, min_df: int):
    """(terms, indices, row starts, targets): the rows over terms that ``min_df`` rows or more have."""
    import numpy as np
    every = np.concatenate([t for _, t in rows]) if rows else np.zeros(0, dtype=np.uint32)
    u, n = np.unique(every, return_counts=True)
    keep = u[n >= min_df]
    at = np.searchsorted(keep, every).clip(max=max(0, len(keep) - 1))
    ok = keep[at] == every if len(keep) else np.zeros(len(every), dtype=bool)
    owner = np.repeat(np.arange(len(rows)), [len(t) for _, t in rows])[ok]
    starts = np.searchsorted(owner, np.arange(len(rows) + 1))
    return keep, at[ok], starts, np.array([y for y, _ in rows], dtype=np.int64)


def batches_of(n: int, size: int, rng):
    order = rng.permutation(n)
    for i in range(0, n, size):
        yield order[i:i + size]


def gather(index, starts, rows):
    """(indices, owner) of some rows of a sparse matrix, owners numbered from 0."""
    import numpy as np
    n = starts[rows + 1] - starts[rows]
    owner = np.repeat(np.arange(len(rows)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[rows], n)
    return index[at], owner


def dump(**arrays) -> bytes:
    import io

    import numpy as np
    f = io.BytesIO()
    np.savez(f, **arrays)
    return f.getvalue()


def load(blob: bytes) -> dict:
    import io

    import numpy as np
    z = np.load(io.BytesIO(blob))
    return {k: z[k] for k in z.files}
