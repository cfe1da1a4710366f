import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

from boxpace.llm import bpe
from boxpace.llm.catalog import BPE_FILE

PATH = P.path(BPE_FILE)


@pytest.fixture(scope="module")
def enc():
    with open(PATH, "rb") as f:
        return bpe.encoding(f.read(), P.PATTERN)


def test_pieces_give_the_whole_texts_ids(enc):
    rng = random.Random(1)
    parts = ["a", "Word", "don't", "'s", "'", " ", "  ", "\n", "\t", " \n ", "\u00a0", "\u2003", "123", "!?", "é", "\U0001f600",
             "\x1c", "\x85", "漢字", "<|endoftext|>", " " * 12, "\n" * 9]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 80)))
        want = enc.encode_ordinary(text)
        for chunk, blanks in ((1, 2), (3, 4), (7, 5), (20, 10)):
            assert bpe.encode_text(enc, text, chunk, blanks).tolist() == want
            assert "".join(p for p, _ in bpe.safe_pieces(text, chunk, blanks)) == text


def test_texts_the_library_cannot_take_whole(enc):
    for unit in (" ", "\n", " \n", "a", "x "):
        text = unit * (1_200_000 // len(unit)) + "end"
        ids = bpe.encode_text(enc, text)
        assert enc.decode_bytes(ids.tolist()).decode() == text


def test_edges(spark, edge, clash, empty, edge_rows, enc):
    for docs in (edge, clash):
        got = {}
        for r in bpe.encode(docs, PATH, P.PATTERN, with_decoded=True).collect():
            got.setdefault(r["doc_id"], []).append((r["n_tokens"], bytes(r["token_ids"]), bytes(r["decoded"])))
        want = {}
        for i, t, *_ in edge_rows:
            ids = enc.encode_ordinary(t or "")
            want.setdefault(i, []).append((len(ids), np.array(ids, dtype="<u4").tobytes(), (t or "").encode()))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert bpe.encode(empty, PATH, P.PATTERN).count() == 0


def test_decode_and_unpack(spark, edge, enc):
    tokens = bpe.encode(edge.where("doc_id in (1, 4, 12)"), PATH, P.PATTERN)
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode(tokens, PATH, P.PATTERN).collect()}
    texts = {r["doc_id"]: r["text"] for r in edge.where("doc_id in (1, 4, 12)").collect()}
    assert back == texts
    ids = {r["doc_id"]: r["ids"] for r in bpe.ids_array(tokens).collect()}
    assert ids == {k: enc.encode_ordinary(v) for k, v in texts.items()}


def test_query_against_the_library(spark, enc):
    from boxpace.llm.catalog import op1_bpe
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op1_bpe(spark, sf).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
