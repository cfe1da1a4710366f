import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxpace.llm import hashed, ordinal, toxicity

SF = "/root/testdata/sf0.1"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_machine_learns_pairs():
    """An insult alone or a group alone is harmless, both together are not: no sum of weights tells that."""
    rng = random.Random(1)
    rows = []
    for _ in range(3000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        terms = {f"w{rng.randrange(200)}" for _ in range(12)} | ({"insult"} if insult else set()) | ({"group"} if group else set())
        rows.append((int(insult and group), hashed.term_hashes(terms)))
    model = hashed.load(toxicity.fit_fm(rows[:2400], l1=0.5))
    p = {k: toxicity.score_terms(model, hashed.term_hashes(k)) for k in (("insult",), ("group",), ("insult", "group"))}
    assert p["insult", "group"] > 0.7 > 0.3 > max(p["insult",], p["group",])
    linear = dict(model, v=np.zeros_like(model["v"]))
    full = [toxicity.score_terms(model, t) for _, t in rows[2400:]]
    flat = [toxicity.score_terms(linear, t) for _, t in rows[2400:]]
    y = [a for a, _ in rows[2400:]]
    loss = lambda q: -np.mean([np.log(x if a else 1 - x) for x, a in zip(np.clip(q, 1e-6, 1 - 1e-6), y)])
    assert np.mean([(x >= 0.5) == bool(a) for x, a in zip(full, y)]) > 0.95
    assert loss(full) < loss(flat)


def test_pairs_are_learned_with_the_registered_parameters():
    """Two words put into the tables' texts, clean alone and toxic together; both draws of them count."""
    import pandas as pd
    docs, labels = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = docs[["doc_id", "text"]].merge(labels[labels.toxic.notna()], on="doc_id")
    terms = [(held(i), int(y), hashed.term_hashes(hashed.word_terms(t or ""))) for i, y, t in zip(known.doc_id, known.toxic, known.text)]
    pair = np.sort(hashed.term_hashes(["zzinsult", "zzgroup"]))
    clean = [t for out, y, t in terms if out and not y][:800]
    both, one = [], []
    for seed in (1, 2):
        rng, rows = np.random.default_rng(seed), []
        for out, y, t in terms:
            if not out:
                has = rng.random(2) < 0.16
                rows.append((int(y or has.all()), np.union1d(t, pair[has])))
        model = hashed.load(toxicity.fit_fm(rows))
        both += [toxicity.score_terms(model, np.union1d(t, pair)) >= 0.3 for t in clean]
        one += [toxicity.score_terms(model, np.union1d(t, pair[k:k + 1])) >= 0.3 for t in clean for k in (0, 1)]
    assert np.mean(both) > 0.5
    assert np.mean(one) < 0.03


def test_thresholds_are_ordered_and_tails_fall():
    rng = random.Random(2)
    rows = []
    for _ in range(3000):
        y = rng.randrange(4)
        rows.append((y, hashed.term_hashes({f"g{y}" if rng.random() < 0.8 else "none"} | {f"w{rng.randrange(99)}" for _ in range(8)})))
    model = hashed.load(ordinal.fit_ordinal(rows, 4))
    assert (np.diff(model["cuts"]) > 0).all()
    expected = [ordinal.tails(model, hashed.term_hashes([f"g{y}"])).sum() for y in range(4)]
    assert expected == sorted(expected) and expected[3] - expected[0] > 2
    for y in range(4):
        t = ordinal.tails(model, hashed.term_hashes([f"g{y}"]))
        assert (np.diff(t) <= 0).all()


def test_without_labels(edge, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(edge, labels)
    assert {r["predicted"] for r in toxicity.score(edge, model).collect()} == {0}
    assert toxicity.score(empty, model).count() == 0
    out = ordinal.rate(edge, ordinal.fit(edge, labels, F.col("quality"), 3)).collect()
    assert {round(r["expected_grade"], 6) for r in out} == {1.0}
    assert ordinal.rate(empty, ordinal.fit(empty, labels, F.col("quality"), 3)).count() == 0
    with pytest.raises(ValueError):
        ordinal.fit(edge, labels, F.col("quality"), 1)


def test_edges(edge, clash, edge_rows, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (3, 0, 1), (3, 0, 1), (999, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    model, grades = toxicity.fit(clash, labels), ordinal.fit(clash, labels, F.col("quality"), 2)
    for df in (edge, clash):
        out = toxicity.score(df, model).collect()
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in edge_rows)
        assert all(r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"])) for r in out)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
        assert ordinal.rate(df, grades).count() == len(edge_rows)
        rest = toxicity.drop_toxic(df, model, 0.3)
        assert rest.columns == df.columns
        assert rest.count() == sum(r["score"] < 0.3 for r in out)


def test_held_out_labels_never_train(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    sample = hashed.training_sample(docs, labels, F.col("toxic"), 10_000).collect()
    assert {r["doc_id"] for r in sample} == {i for i in range(400) if not held(i)}
    assert hashed.training_sample(docs, labels, F.col("toxic"), 50).count() == 50


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    out = toxicity.score(docs, toxicity.fit(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    bad = [r["predicted"] for r in out if r["toxic"] == 1]
    good = [r["predicted"] for r in out if r["toxic"] == 0]
    assert len(bad) > 50 and sum(bad) / len(bad) > 0.8
    assert sum(good) / len(good) < 0.01


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    model = ordinal.fit(docs, labels, F.col("quality") * (2 - F.col("toxic")), 3)
    out = ordinal.rate(docs, model).join(labels, "doc_id").where(hashed.held_out("doc_id")).collect()
    junk = [r["kept"] for r in out if r["quality"] == 0]
    good = [r["kept"] for r in out if r["quality"] == 1]
    assert sum(junk) / len(junk) < 0.1
    assert sum(good) / len(good) > 0.97
    clean = np.mean([r["expected_grade"] for r in out if r["quality"] == 1 and r["toxic"] == 0])
    toxic = np.mean([r["expected_grade"] for r in out if r["quality"] == 1 and r["toxic"] == 1])
    assert clean > toxic > np.mean([r["expected_grade"] for r in out if r["quality"] == 0])


def plain_terms(text):
    """The terms of the quality model, word by word."""
    import re
    from collections import Counter

    from boxpace.llm.hashed import word_terms
    words, shapes = text.split(), Counter()
    for i, w in enumerate(words):
        body = w.strip(".,;:?")
        shapes["again"] += bool(i and w == words[i - 1])
        shapes["upper"] += len(body) > 1 and body.isupper()
        shapes["mark"] += not any(c.isalnum() for c in body)
        for end in re.findall(r"[^\w\s.,;:?'\"()-]{2,}$", body):
            shapes["end"] += 1
            shapes["end" + end[:3]] += 1
        shapes["digit"] += any(c.isdigit() for c in body)
    n = max(1, len(words))
    return word_terms(text) | {f"#{k}:{(64 * c // n).bit_length()}" for k, c in shapes.items() if c} | {
        f"#words:{len(words).bit_length()}", f"#kinds:{8 * len(set(words)) // n}"}


def test_quality_terms_word_by_word():
    import random

    import duckdb

    from boxpace.llm.ordinal import quality_terms
    rng = random.Random(1)
    texts = [t or "" for t, in duckdb.sql("SELECT text FROM read_parquet('/root/testdata/sf0.001/documents.parquet')").fetchall()]
    texts += ["".join(rng.choice("aAbB12.,;:?!£€ \n\t'\"()-²Ⅷǅ中_") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    assert all(quality_terms(t) == plain_terms(t) for t in texts)


def test_ratings_equal_the_formula_word_by_word(spark):
    """Grades by the cumulative-link formula, summed over plain terms; the fit is likelier than the shares of the grades."""
    import math

    rng = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        g = rng.randrange(3)
        docs.append((i, " ".join(rng.choice(["plain", "word", "text", *["bad"] * (2 - g), *["fine"] * g]) for _ in range(20))))
        labels.append((i, g))
    docs.append((900, ""))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = ordinal.fit(d, spark.createDataFrame(labels, "doc_id long, grade int"), F.col("grade"), 3)
    m = hashed.load(model)
    weight = dict(zip(m["terms"].tolist(), m["w"].tolist()))
    got = {r["doc_id"]: (r["expected_grade"], r["tail_prob"]) for r in ordinal.rate(d, model).collect()}
    grade, fitted, constant = dict(labels), 0.0, 0.0
    share = [sum(g == k for g in grade.values()) / len(grade) for k in range(3)]
    for i, text in docs:
        place = sum(weight.get(h, 0.0) for h in {zlib.crc32(t.encode()) for t in plain_terms(text)})
        tail = [1 / (1 + math.exp(-(place - c))) for c in m["cuts"]]
        assert tail[0] > tail[1]
        assert got[i] == (pytest.approx(sum(tail)), pytest.approx(tail[0]))
        if i in grade:
            p = [1 - tail[0], tail[0] - tail[1], tail[1]]
            fitted -= math.log(p[grade[i]])
            constant -= math.log(share[grade[i]])
    assert fitted < 0.6 * constant


def test_scores_equal_a_double_loop_over_pairs(spark):
    """Bias, weights and every pair's product of vectors, added one by one."""
    import math

    rng = random.Random(3)
    docs, labels = [], []
    for i in range(3000):  # toxic only where both words stand
        a, b = rng.random() < 0.5, rng.random() < 0.5
        docs.append((i, " ".join([rng.choice("pqrstu") * 3 for _ in range(6)] + ["insult"] * a + ["group"] * b)))
        labels.append((i, int(a and b)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    m = hashed.load(model)
    at = {t: k for k, t in enumerate(m["terms"].tolist())}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    paired = 0
    for i, text in docs[:300]:
        ks = sorted(at[h] for h in {zlib.crc32(t.encode()) for t in hashed.word_terms(text)} if h in at)
        z = float(m["w0"][0]) + sum(float(m["w"][k]) for k in ks)
        pairs = sum(float(x) * float(y) for n, j in enumerate(ks) for k in ks[:n] for x, y in zip(m["v"][j], m["v"][k]))
        paired += abs(pairs) > 0.1
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z + pairs)))), abs=1e-6)
    assert paired > 50
    held = {r["doc_id"]: r["predicted"] for r in toxicity.score(d, model).where("held_out").collect()}
    right = sum(held[i] == y for i, y in labels if i in held) / len(held)
    assert right > 0.95
