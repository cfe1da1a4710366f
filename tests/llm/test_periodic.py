import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boxpace.llm.periodic import COVER, V, Extensions, collapse, find_runs, greatest, periodic_runs, plant_runs


def brute_runs(w, min_words=24, min_repeats=3):
    """Every maximal stretch of every period; the smallest period of a stretch names it."""
    out = {}
    for p in range(1, len(w) // min_repeats + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(min_words, min_repeats * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def brute(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = brute_runs(words)
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    return i, runs, best, " ".join(w for k, w in enumerate(words) if k not in gone)


def brute_plant(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 or not words:
        return text
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(w if k < a else words[a + (k - a) % p] for k, w in enumerate(words))


def rows_of(df, **kw):
    return [(r["doc_id"], [tuple(x) for x in r["runs"]], r["best"] and tuple(r["best"]), r["collapsed"])
            for r in periodic_runs(df, **kw).collect()]


def arrays(docs):
    return [np.array(d, dtype=np.int64) for d in docs]


def test_cover_meets_every_difference():
    assert {(a - b) % V for a in COVER for b in COVER} == set(range(V))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=140), st.randoms())
def test_extensions_equal_word_by_word(words, rng):
    w = np.array([*words, 9], dtype=np.int64)
    e = Extensions(w)
    a = np.array([rng.randrange(len(w)) for _ in range(60)])
    b = np.array([rng.randrange(len(w)) for _ in range(60)])
    a, b = a[a != b], b[a != b]
    want = []
    for x, y in zip(a.tolist(), b.tolist()):
        k = 0
        while max(x, y) + k < len(w) and w[x + k] == w[y + k]:
            k += 1
        want.append(k)
    assert e.common(a, b).tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=30), st.integers(1, 6)), max_size=8),
       st.sampled_from([(24, 3), (2, 2), (6, 3), (10, 2), (40, 5)]))
def test_runs_equal_plain_search(parts, limits):
    docs = [w * k for w, k in parts] + [[x for w, k in parts for x in w * k]]
    got = find_runs(arrays(docs), *limits)
    assert [[tuple(r) for r in g.tolist()] for g in got] == [brute_runs(d, *limits) for d in docs]


@pytest.mark.parametrize("seed", range(4))
def test_runs_in_long_texts(seed):
    rng = random.Random(seed)
    w = [rng.randrange(400) for _ in range(3000)]
    w[500:1400] = (w[500:797] * 4)[:900]
    w[2000:2100] = [7] * 100
    assert [tuple(r) for r in find_runs(arrays([w]))[0].tolist()] == brute_runs(w)


def test_runs_end_at_text_borders():
    one = [1, 2, 3] * 10
    assert [g.tolist() for g in find_runs(arrays([one, one, [], one[:23], one[:24]]))] == [
        [[0, 30, 3]], [[0, 30, 3]], [], [], [[0, 24, 3]]]


def test_one_word_a_hundred_thousand_times_and_many_repeats_of_a_long_stretch():
    rng = random.Random(1)
    stretch = [rng.randrange(5000) for _ in range(1000)]
    got = find_runs(arrays([[4] * 100_000, stretch * 60]))
    assert [g.tolist() for g in got] == [[[0, 100_000, 1]], [[0, 60_000, 1000]]]


def test_greatest_is_exact():
    assert greatest([(0, 30, 10), (40, 24, 8), (90, 31, 10)]) == (90, 31, 10)
    assert greatest([(5, 24, 8), (6, 48, 16)]) == (5, 24, 8)
    assert greatest([]) is None
    assert collapse(list("abababababc"), np.array([[0, 10, 2]])) == ["a", "b", "c"]


def test_edges(edge, clash, empty, edge_rows, spark):
    want = sorted(map(repr, (brute(r[0], r[1]) for r in edge_rows)))
    assert sorted(map(repr, rows_of(edge))) == want
    assert sorted(map(repr, rows_of(clash))) == want
    assert rows_of(empty) == [] and rows_of(plant_runs(empty)) == []
    rows = [(1, "a b\tc " * 9), (1, "a b\tc " * 9), (None, "x " * 24), (2, "  y\n" * 30 + "z"), (3, "x " * 23)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(repr, rows_of(df))) == sorted(map(repr, (brute(*r) for r in rows)))


def test_planted_runs(spark, edge, edge_rows):
    rng = random.Random(8)
    rows = [(i, " \n".join(str(rng.randrange(30)) for _ in range(rng.choice([0, 1, 2, 30, 90, 400])))) for i in range(300)]
    rows += [(None, "a b"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in plant_runs(df).collect()), key=repr)
    assert got == sorted(((i, brute_plant(i, t)) for i, t in rows), key=repr)
    assert sum(brute_plant(i, t) != t for i, t in rows) > 15
    got = sorted((tuple(r) for r in plant_runs(edge).collect()), key=repr)
    assert got == sorted(((r[0], brute_plant(r[0], r[1])) for r in edge_rows), key=repr)


def test_query_on_the_tables(spark):
    import duckdb

    from boxpace.llm.catalog import LLM_QUERIES
    sf = "/root/testdata/sf0.001"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet')").fetchall():
        _, runs, best, collapsed = brute(i, brute_plant(i, text))
        want.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                     sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(collapsed)))
    got = [tuple(r) for r in LLM_QUERIES["op13_periodic"](spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in got) >= 5
