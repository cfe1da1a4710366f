from collections import defaultdict

import numpy as np
import pytest

from boxpace.llm import lines

B = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_chars=40, min_docs=5):
    held, last = defaultdict(int), {}
    cut = [(i, (t or "").split("\n")) for i, t in rows]
    rank = lambda i: -1 if i is None else i
    for i, ls in cut:
        for k in {lower(x.strip(B)) for x in ls}:
            if len(k) >= min_chars:
                held[k] += 1
                last[k] = max(last.get(k, -1), rank(i))
    out = []
    for i, ls in cut:
        rest = [x for x in ls if not (held.get(lower(x.strip(B)), 0) >= min_docs and last[lower(x.strip(B))] != rank(i))]
        out.append((i, len(ls), len(ls) - len(rest), "\n".join(rest)))
    return out


def check(df, rows, **kw):
    got = [tuple(r) for r in lines.dedup_lines(df, **kw).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows, **kw)))


def test_edges(edge, clash, empty, edge_rows):
    rows = [(r[0], r[1]) for r in edge_rows]
    check(edge, rows)
    check(clash, rows)
    check(edge, rows, min_chars=1, min_docs=2)
    check(empty, [])


def test_hot_line_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 8)
    monkeypatch.setattr(lines, "SALT_PROBES", 40)
    hot = "This line is held by every second one of all documents."
    rows = [(i, "\n".join([hot] * (i % 2) + [f"A passage of more than forty characters, number {(i * 7 + j) % 90}." for j in range(4)]
                          + [f"Only document {i} holds this line of some length."])) for i in range(300)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_shards_of_hot_lines_get_salts_of_their_own(spark):
    rows = [(7, 1, 1000), (3, 1, 5), (10, 1, 6), (4, 1, 39)]  # h1, h2, documents; four shards
    counts = spark.createDataFrame(rows, "h1 long, h2 long, n_docs long")
    got = {r["_hot"]: r["_salts"] for r in lines.hot_shards(counts, 4, 1, 10).collect()}
    assert got == {3: 101, 0: 4}
    assert lines.hot_shards(counts, 4, 200, 10).count() == 0


def test_only_rows_without_ids_hold_a_line(spark):
    rows = [(None, "A line that only rows without an id have here.")] * 6
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


@pytest.mark.parametrize("n", [1, 2, 100, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(0, 2 ** 63, (2, n)).astype(np.uint64)
    h1[: n // 2] = h1[0]  # first halves alone don't tell the keys apart
    last = np.ma.masked_array(np.arange(n), mask=np.arange(n) % 7 == 3)
    s = lines.Shard(lines.pack_shard(h1, h2, np.arange(n) + 5, last))
    slot, known = s.probe(h1, h2)
    assert known.all() and sorted(slot.tolist()) == list(range(n))
    assert s.count[slot].tolist() == (np.arange(n) + 5).tolist()
    assert s.has[slot].tolist() == (np.arange(n) % 7 != 3).tolist()
    other = rng.integers(0, 2 ** 63, (2, 1000)).astype(np.uint64)
    assert not s.probe(*other)[1].any()


def test_rewritten_rows_keep_their_columns(edge, clash, edge_rows):
    for df in (edge, clash):
        out = lines.rewrite_lines(df)
        assert out.schema.names == df.columns
        want = [(i, t if not d else k, len(k) if d else n) for (i, t, _, _, n), (_, _, d, k)
                in zip(edge_rows, brute([(r[0], r[1]) for r in edge_rows]))]
        got = [tuple(r) for r in out.select("doc_id", "text", "n_chars").collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
