import hashlib
import math
import random

from boxpace.llm.centroids import MAX_VALUE, cluster, table_distances

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, rounds, dims, scale=1024, seed=3):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) by plain loops over Python integers."""
    import numpy as np
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-MAX_VALUE, min(MAX_VALUE, math.floor(scale * float(np.float32(x))))) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [x for _, x in order[:k]]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda x: min((dist(x, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = [[] for _ in cents]
        for _, x in kept:
            groups[near(x)[1]].append(x)
        cents = [[sum(col) // len(g) for col in zip(*g)] if g else c for g, c in zip(groups, cents)]
    got = [(i, *near(x)[::-1]) for i, x in kept]
    total = sum(d for _, _, d in got)
    return [(i, c, d, sum(e for _, b, e in got if b == c), total, cents[c]) for i, c, d in got]


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in cluster(df, **kw).collect()]
    kw.pop("block_rows", None)
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows, **kw)))


def test_equals_plain_loops(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 5, 0.4) for _ in range(4)]) for i in range(90)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (None, [0.0] * 4)]
    check(spark, rows, k=5, rounds=4, dims=4)
    check(spark, rows, k=5, rounds=0, dims=4, block_rows=7)


def test_rows_that_are_left_out_and_large_components(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5]), (2, None), (3, []), (4, [1.0]), (5, [1.0, 2.0, 3.0]), (6, [None, 1.0]), (7, [nan, 1.0]),
            (8, [inf, 1.0]), (9, [1.0, -inf]), (10, [-0.0001, 0.0001]), (11, [3e38, -3e38]), (12, [200000.0, -5.0])]
    check(spark, rows, k=2, rounds=3, dims=2)


def test_fewer_vectors_than_centroids_ties_and_empty_clusters(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])]
    check(spark, rows, k=8, rounds=2, dims=2)
    check(spark, rows[:1], k=8, rounds=2, dims=2)
    check(spark, [], k=8, rounds=2, dims=2)


def test_hot_vector_and_clashing_columns(spark):
    rng = random.Random(6)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [rng.random() for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    clash = df.selectExpr("*", *[f"1 AS {c}" for c in ("cluster", "distance", "x", "ids", "codes", "inertia", "centroid", "_c")])
    got = [tuple(r) for r in cluster(clash, k=4, rounds=3, dims=3, block_rows=64).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows, 4, 3, 3)))


def test_tables_hold_only_occurring_values():
    import numpy as np
    x = np.array([[-MAX_VALUE, 3], [MAX_VALUE, 3], [0, 5]])
    values, codes, starts = [], [], [0]
    for d in range(2):
        u, c = np.unique(x[:, d], return_inverse=True)
        values.append(u)
        codes.append(c)
        starts.append(starts[-1] + len(u))
    cents = np.array([[MAX_VALUE, 0], [1, 4]])
    got = table_distances(np.concatenate(values), np.array(starts), np.stack(codes), cents)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c)) for c in cents] for r in x]
    assert got.tolist() == want
