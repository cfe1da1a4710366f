"""Each stage against a brute-force version, and the whole run."""
import random
from collections import Counter

import public_tokenizers as P
import pytest

import corpus_pipeline
from boxpace.llm import bpe, mixing, toxicity
from boxpace.llm.catalog import BPE_FILE

from test_jaccard import brute as near_groups
from test_lines import brute as line_brute

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stage_names():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join",
                                                      "mixing sources to target weights", "byte-level BPE"]


def test_toxicity_stage(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    m = toxicity.scorer(toxicity.fit(docs, labels))
    want = [tuple(r) for r in docs.collect() if m(r["text"] or "") < 0.3]
    got = STAGE["toxicity"](spark, docs, SF)
    assert got.columns == COLUMNS
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_line_stage(spark, docs):
    rows = docs.collect()
    left = line_brute([(r["doc_id"], r["text"]) for r in rows])
    want = [(r["doc_id"], t if n else r["text"], r["lang"], r["source"], len(t) if n else r["n_chars"])
            for r, (_, _, n, t) in zip(rows, left)]
    got = STAGE["line dedup"](spark, docs, SF)
    assert got.columns == COLUMNS
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_near_duplicate_stage(spark, docs):
    rows = docs.collect()
    want = [tuple(r) for r, (i, n, c) in zip(rows, near_groups([(r["doc_id"], r["text"]) for r in rows])) if not n or i == c]
    got = STAGE["n-gram Jaccard join"](spark, docs, SF)
    assert got.columns == COLUMNS
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_mixing_stage(spark, docs):
    got = STAGE["mixing sources to target weights"](spark, docs, SF)
    assert got.columns == COLUMNS
    out, rows = got.collect(), {tuple(r) for r in docs.collect()}
    assert {tuple(r) for r in out} <= rows
    rates = {r["source"]: r["rate"] for r in mixing.source_rates(docs, mixing.temperature_targets(docs, 0.5)).collect()}
    n = Counter(r["source"] for r in docs.collect())
    weight = {s: k ** 0.5 for s, k in n.items()}
    for s in n:
        assert rates[s] == pytest.approx(weight[s] / sum(weight.values()) * sum(n.values()) / n[s])
    assert len(out) == pytest.approx(len(rows), rel=0.3)


def test_token_stage(spark, docs):
    with open(P.path(BPE_FILE), "rb") as f:
        enc = bpe.encoding(f.read(), P.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = STAGE["byte-level BPE"](spark, docs, SF).collect()
    assert len(out) == len(texts)
    for r in random.Random(1).sample(out, 60):
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert bytes(r["token_ids"]) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert r["n_tokens"] == len(ids)


@pytest.mark.parametrize("name", [k for k, _ in corpus_pipeline.STAGES])
def test_stages_take_edges(spark, name, edge, clash, empty, edge_rows):
    for df in (edge, clash, empty):
        out = STAGE[name](spark, df, SF)
        rows = out.collect()
        assert len(rows) <= (0 if df is empty else len(edge_rows) * 4)
        if name != "byte-level BPE":
            assert out.columns == df.columns


def test_run_keeps_what_the_stages_keep(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    pick = lambda df: Counter((r["doc_id"], bytes(r["token_ids"])) for r in df.collect())
    assert pick(out) == pick(docs)
    assert out.count() > 50
