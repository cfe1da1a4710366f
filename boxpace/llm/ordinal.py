"""Quality by ordinal regression on graded ratings (operator 3).

A cumulative-link model: one set of weights over hashed terms gives a text's position, and
ordered thresholds cut it into grades, P(grade >= k) = logistic(position - threshold k). The weights
are shared by all grades, so a rating of 1 against 2 also teaches what tells 0 from 1. The expected
grade ranks texts; the tail probability of a grade selects them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts
from .hashed import (batches_of, dump, gather, load, sparse_rows, term_hashes, train_on_one, training_sample,
                     word_terms)

# Rated rows a model is fitted on, at most.
MAX_TRAIN_ROWS = 12_288
MIN_DF = 5


def word_shapes(w: str) -> list[str]:
    """What one word looks like."""
    import re
    body, out = w.strip(".,;:?"), []
    if len(body) > 1 and body.isupper():
        out.append("upper")
    if not any(c.isalnum() for c in body):
        out.append("mark")
    for end in re.findall(r"[^\w\s.,;:?'\"()-]{2,}$", body):
        out += ["end", "end" + end[:3]]
    if any(c.isdigit() for c in body):
        out.append("digit")
    return out


def quality_terms(text: str) -> set[str]:
    """Words, and terms for what words look like: the share of each shape in eighths, rounded up on a log scale."""
    from collections import Counter
    from operator import eq
    words = text.split()
    kinds = Counter(words)
    shapes = Counter({"again": sum(map(eq, words[1:], words))})
    for w, c in kinds.items():
        # Plain words, nearly all of them, have no shape; the others are looked at once per text.
        if not w.isalpha() or w.isupper():
            for shape in word_shapes(w):
                shapes[shape] += c
    n = max(1, len(words))
    out = {f"#{k}:{(64 * c // n).bit_length()}" for k, c in shapes.items() if c}
    out.add(f"#words:{len(words).bit_length()}")
    out.add(f"#kinds:{8 * len(kinds) // n}")
    return word_terms(text) | out


def fit_ordinal(rows, grades: int, epochs: int = 8, batch: int = 32, rate: float = 0.5, l1: float = 4.0,
                l2: float = 0.1, min_df: int = MIN_DF, seed: int = 11) -> bytes:
    """Weights and ``grades`` - 1 rising thresholds fitted to [(grade, hashed terms)].

    Weights follow the regularised leader with an L1 term, which keeps most at 0. Thresholds
    are the first one and positive gaps, so they can't cross. Without rows every
    grade is as likely as the others.
    """
    import numpy as np
    terms, index, starts, y = sparse_rows(rows, min_df)
    y = y.clip(0, grades - 1)
    rng = np.random.default_rng(seed)
    tail = [(float((y >= k).sum()) + (grades - k) / grades) / (len(y) + 1.0) for k in range(1, grades)]
    cut = -np.log(np.array(tail) / (1 - np.array(tail)))
    first, gaps = float(cut[0]), np.log(np.maximum(np.diff(cut), 0.05))
    g_first, g_gaps = 10.0, np.full(grades - 2, 10.0)
    l1 = 0.3 + l1 * min(1.0, len(y) / 4000)
    w, z, n = np.zeros(len(terms)), np.zeros(len(terms)), np.zeros(len(terms))
    for _ in range(epochs):
        for now in batches_of(len(y), batch, rng):
            i, owner = gather(index, starts, now)
            x = np.bincount(owner, w[i], len(now))
            th = first + np.r_[0.0, np.cumsum(np.exp(gaps))]
            # P(y >= k) for k = 0..grades, with its ends.
            up = 1 / (1 + np.exp(-np.clip(x[:, None] - th, -30, 30)))
            full = np.concatenate([np.ones((len(now), 1)), up, np.zeros((len(now), 1))], axis=1)
            at, r = y[now], np.arange(len(now))
            p = np.maximum(full[r, at] - full[r, at + 1], 1e-9)
            slope = full * (1 - full)
            dx = -(slope[r, at] - slope[r, at + 1]) / p
            dth = np.zeros((len(now), grades + 1))
            dth[r, at] += slope[r, at] / p
            dth[r, at + 1] -= slope[r, at + 1] / p
            dth = dth[:, 1:grades].sum(axis=0)
            u, inv = np.unique(i, return_inverse=True)
            dw = np.bincount(inv, dx[owner], len(u))
            step = (np.sqrt(n[u] + dw ** 2) - np.sqrt(n[u])) / rate
            z[u] += dw - step * w[u]
            n[u] += dw ** 2
            w[u] = np.where(np.abs(z[u]) <= l1, 0.0, -(z[u] - np.sign(z[u]) * l1) / ((1 + np.sqrt(n[u])) / rate + l2))
            g_first += dth.sum() ** 2
            first -= 0.2 * dth.sum() / np.sqrt(g_first)
            if grades > 2:
                dg = np.cumsum(dth[::-1])[::-1][1:] * np.exp(gaps)
                g_gaps += dg ** 2
                gaps -= 0.2 * dg / np.sqrt(g_gaps)
    keep = w != 0
    return dump(terms=terms[keep], w=w[keep].astype(np.float32), cuts=first + np.r_[0.0, np.cumsum(np.exp(gaps))])


def tails(model: dict, hashes):
    """P(grade >= 1), P(grade >= 2), ... of one text's hashed terms."""
    import numpy as np
    terms, x = model["terms"], 0.0
    if len(terms) and len(hashes):
        at = np.searchsorted(terms, hashes).clip(max=len(terms) - 1)
        x = float(model["w"][at[terms[at] == hashes]].sum(dtype=np.float64))
    return 1 / (1 + np.exp(-np.clip(x - model["cuts"], -30, 30)))


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, grades: int, max_rows: int = MAX_TRAIN_ROWS,
        id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """The model for ``grade`` (0 to ``grades`` - 1) of ``ratings``, from at most ``max_rows`` rows not held out."""
    if grades < 2:
        raise ValueError("two grades or more")
    sample = training_sample(docs, ratings, grade, max_rows, id_col, text_col)
    return train_on_one(sample, quality_terms, lambda rows: fit_ordinal(rows, grades))


def rate(docs: DataFrame, model: bytes, min_grade: int = 1, min_tail: float = 0.5, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tail_prob, kept) of every row of ``docs``.

    ``tail_prob`` is P(grade >= ``min_grade``); rows of ``min_tail`` or more are kept. A NULL text is
    empty and rated as such. NULL ids stay NULL, repeated rows are rated each, an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa
        m = load(shared.value)
        for b in batches:
            t = [tails(m, term_hashes(quality_terms(x))) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([float(x.sum()) for x in t], pa.float64()),
                 pa.array([float(x[min_grade - 1]) for x in t], pa.float64())], names=["doc_id", "expected_grade", "tail_prob"])
    out = texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, expected_grade double, tail_prob double")
    return out.withColumn("kept", F.col("tail_prob") >= min_tail)
