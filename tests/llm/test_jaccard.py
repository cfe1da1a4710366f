import random
import re
from collections import defaultdict

import numpy as np
import pytest

from boxpace.llm import jaccard


def shingles(t):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                up[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)].append(i)
    return [(i, len(sets[k]), min(ids[find(k)], default=None)) for k, (i, _) in enumerate(rows)]


def check(df, rows, **kw):
    got = [tuple(r)[:3] for r in jaccard.jaccard_groups(df, **kw).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


def near_copies(seed):
    """Chains and clouds of edited copies, many pairs just around 80 %, and a passage all of them share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(30)]
    rows = []
    for _ in range(25):
        text = [word() for _ in range(rng.choice([1, 3, 5, 6, 9, 20, 60, 90]))]
        for _ in range(rng.randint(1, 9)):
            rows.append(" ".join(shared + text if rng.random() < 0.3 else text))
            for _ in range(rng.randint(0, 2)):
                text = text[:]
                k = rng.randrange(len(text))
                text[k:k + rng.randint(0, 2)] = [word() for _ in range(rng.randint(0, 2))]
                text = text or [word()]
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows))


@pytest.mark.parametrize("seed,tile,small", [(1, 2048, 1 << 20), (2, 2, 1 << 20), (3, 5, 0)])
def test_near_copies(spark, monkeypatch, seed, tile, small):
    monkeypatch.setattr(jaccard, "MAX_BROADCAST_CLASSES", small)
    monkeypatch.setattr(jaccard, "PARTNERS", 2)
    rows = near_copies(seed)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, tile=tile)


def test_edges(edge, clash, empty, edge_rows):
    rows = [(r[0], r[1]) for r in edge_rows]
    check(edge, rows)
    check(clash, rows)
    check(empty, [])


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(4)
    for n in (1, 5, 40, 700, 5000):
        pool = np.unique(rng.integers(0, 2 ** 63, 2 * n).astype(np.uint64))
        a = np.sort(rng.choice(pool, min(n, len(pool)), replace=False))
        for m in (max(1, int(0.8 * n)), n):
            b = np.sort(rng.choice(pool, min(m, len(pool)), replace=False))
            u, v = (np.frombuffer(jaccard.bitmap(x, *jaccard.TILE_BITS), dtype=np.uint64)[None, :] for x in (a, b))
            w = min(u.shape[1], v.shape[1])
            bound = jaccard.overlap_bound(jaccard.fold(u, w)[0], len(a), jaccard.fold(v, w), len(b))[0]
            assert len(np.intersect1d(a, b)) <= bound <= min(len(a), len(b))


def test_words_and_shingles():
    rng = random.Random(9)
    small = jaccard.WordHasher(64)
    for _ in range(300):
        n = rng.choice([0, 1, 4, 5, 9, 80])
        words = ["".join(rng.choice("aBcé") for _ in range(rng.choice([1, 2, 5, 40, 90]))) for _ in range(n)]
        text = "".join(rng.choice([" ", "\n", "\t  ", "\x0b"]) + w for w in words) + rng.choice(["", " "])
        got = small(text.encode())
        want = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
        assert len(got) == n
        assert len({*got.tolist()}) == len({*want})
        assert {w: h for w, h in zip(want, got.tolist())} == {w: int(small(w.encode())[0]) for w in want}
        assert len(jaccard.shingle_set(text.encode(), small)) == len(shingles(text))


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 499), (499, 500), (700, 700)]
    rng.shuffle(edges)
    got = {r["cid"]: r["label"] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {499: 499, 500: 499}
    assert got == want


def test_rows_that_stay(edge, clash, edge_rows):
    rows = [(r[0], r[1]) for r in edge_rows]
    groups = brute(rows)
    want = sorted({i for i, n, c in groups if n and i == c and i is not None})
    blank = sorted(str(i) for i, n, _ in groups if not n)
    for df in (edge, clash):
        out = jaccard.keep_first(df)
        assert out.columns == df.columns
        got = out.collect()
        assert sorted(r["doc_id"] for r in got if shingles(r["text"]) and r["doc_id"] is not None) == want
        assert sorted(str(r["doc_id"]) for r in got if not shingles(r["text"])) == blank


def test_many_near_copies_of_one_text_give_few_pairs(spark, monkeypatch):
    """Thousands of copies that share one rare shingle: linked as one group through pairs in proportion to them."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    base = [word() for _ in range(40)]
    rows = []
    for i in range(3000):
        text = base[:]
        text[rng.randrange(30, 40)] = word()
        rows.append((i, " ".join(text)))
    counted, tile_pairs = [], jaccard.tile_pairs

    def counting(*a, **kw):
        out = tile_pairs(*a, **kw)
        counted.append(out.count())
        return out
    monkeypatch.setattr(jaccard, "tile_pairs", counting)
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), tile=256).collect()
    sets = [shingles(t) for _, t in rows]
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, _, c in brute_by_edit(rows, sets)}
    assert sum(counted) <= 3 * len(rows)


def brute_by_edit(rows, sets):
    """Components by checking, per text, texts whose edited word stands at a near place (others share too little)."""
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if find(a) != find(b):
                o = len(sets[a] & sets[b])
                if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                    up[find(a)] = find(b)
    low = defaultdict(lambda: 1 << 60)
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low[find(k)], i)
    return [(i, len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(rows)]
