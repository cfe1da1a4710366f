"""Toxicity by a factorization machine over hashed terms (operator 7).

Each term has a weight and a short vector; a text's score is the logistic of the
bias, its terms' weights and the products of every two of its terms' vectors. So the machine
can learn that two terms together (an insult and the mention of a group) weigh more, or
less, than each alone, which additive weights can't. The sum over pairs is computed from
the sum of vectors, in time linear in the terms.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts
from .hashed import (batches_of, dump, gather, held_out, load, sparse_rows, term_hashes, train_on_one, training_sample,
                     word_terms)

# Labelled rows a model is fitted on, at most.
MAX_TRAIN_ROWS = 12_288
FACTORS = 4
MIN_DF = 3


def fit_fm(rows, factors: int = FACTORS, epochs: int = 8, batch: int = 32, rate: float = 0.5, l1: float = 6.0,
           l2: float = 0.1, min_df: int = MIN_DF, seed: int = 7, l1_pairs: float = 8.0, l2_pairs: float = 1.0,
           noise: float = 1.0, start: float = 0.01) -> bytes:
    """A machine fitted to [(0 or 1, hashed terms)] on mini-batches.

    Weights follow the regularised leader with an L1 term: a term keeps a weight of 0 unless
    it tells the labels apart, so long texts gather no noise. Vectors are learned for all terms, with or without
    a weight, the same way: each has a small random start, which it leaves when its gradients add up to more than
    ``l1_pairs`` (given for MAX_TRAIN_ROWS rows, it shrinks with the square root of the rows) and ``noise`` times the
    root of their sum of squares, what signs at random would give; one that never does is 0 in the
    model. The bias starts below the base rate, so that terms have to raise a score.
    Without rows the machine knows a
    low base rate only.
    """
    import numpy as np
    terms, index, starts, y = sparse_rows(rows, min_df)
    rng = np.random.default_rng(seed)
    base = (y.sum() + 0.1) / (len(y) + 1.0)
    w0, g0 = float(np.log(base / (1 - base))) - 3.0 * (len(y) > 0), 1.0
    l1_pairs *= np.sqrt(min(1.0, len(y) / MAX_TRAIN_ROWS))
    w, z, n = np.zeros(len(terms)), np.zeros(len(terms)), np.zeros(len(terms))
    v0 = rng.normal(0, start, (len(terms), factors))
    v, zv, nv = v0.copy(), np.zeros(v0.shape), np.zeros(v0.shape)
    for _ in range(epochs):
        for rows_now in batches_of(len(y), batch, rng):
            i, owner = gather(index, starts, rows_now)
            m, vi = len(rows_now), v[i]
            s = np.stack([np.bincount(owner, vi[:, f], m) for f in range(factors)], axis=1)
            q = np.bincount(owner, (vi ** 2).sum(axis=1), m)
            out = w0 + np.bincount(owner, w[i], m) + 0.5 * ((s ** 2).sum(axis=1) - q)
            e = 1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[rows_now]
            u, inv = np.unique(i, return_inverse=True)
            dw = np.bincount(inv, e[owner], len(u))
            step = (np.sqrt(n[u] + dw ** 2) - np.sqrt(n[u])) / rate
            z[u] += dw - step * w[u]
            n[u] += dw ** 2
            w[u] = np.where(np.abs(z[u]) <= l1, 0.0, -(z[u] - np.sign(z[u]) * l1) / ((1 + np.sqrt(n[u])) / rate + l2))
            d0 = e.sum()
            g0 += d0 ** 2
            w0 -= 0.2 * d0 / np.sqrt(g0)
            part = e[owner][:, None] * (s[owner] - vi)
            dv = np.stack([np.bincount(inv, part[:, f], len(u)) for f in range(factors)], axis=1)
            step = (np.sqrt(nv[u] + dv ** 2) - np.sqrt(nv[u])) / rate
            zv[u] += dv - step * (v[u] - v0[u])
            nv[u] += dv ** 2
            norm = np.sqrt((zv[u] ** 2).sum(axis=1))[:, None]
            limit = l1_pairs + noise * np.sqrt(nv[u].sum(axis=1))[:, None]
            past = np.maximum(0.0, 1 - limit / np.maximum(norm, 1e-12))
            v[u] = v0[u] - past * zv[u] / ((1 + np.sqrt(nv[u])) / rate + l2_pairs)
    v[np.sqrt((zv ** 2).sum(axis=1)) <= l1_pairs + noise * np.sqrt(nv.sum(axis=1))] = 0.0
    keep = (w != 0) | v.any(axis=1)
    return dump(terms=terms[keep], w0=np.array([w0]), w=w[keep].astype(np.float32), v=v[keep].astype(np.float32))


def score_terms(model: dict, hashes) -> float:
    """Score in (0, 1) of one text's hashed terms; unknown terms add nothing."""
    import numpy as np
    terms, z = model["terms"], float(model["w0"][0])
    if len(terms) and len(hashes):
        at = np.searchsorted(terms, hashes).clip(max=len(terms) - 1)
        at = at[terms[at] == hashes]
        v = model["v"][at].astype(np.float64)
        z += model["w"][at].sum(dtype=np.float64) + 0.5 * float((v.sum(axis=0) ** 2).sum() - (v ** 2).sum())
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def scorer(model: bytes):
    """The function text -> score of a fitted machine."""
    m = load(model)
    return lambda text: score_terms(m, term_hashes(word_terms(text)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = MAX_TRAIN_ROWS,
        id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """The machine for ``labels`` (id, label), from at most ``max_rows`` labelled rows that are not held out."""
    sample = training_sample(docs, labels, F.col(label_col), max_rows, id_col, text_col)
    return train_on_one(sample, word_terms, fit_fm)


def score(docs: DataFrame, model: bytes, threshold: float = 0.3, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Nothing but the text enters a score. A NULL or empty text scores the bias alone. A NULL id is not held
    out; repeated rows are scored each; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa
        one = scorer(shared.value)
        for b in batches:
            s = [one(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])
    out = texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: bytes, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = map_rows(docs, lambda: scorer(shared.value), "double", text_col)
    return scored.where(F.col("value") < threshold).select("row.*")
