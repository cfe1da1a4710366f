import hashlib
import random
import re
from collections import defaultdict

import pytest

from boxpace.llm.blocks import exact_dedup, normalise


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    out, seen = [], set()
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        first = i == keep and t not in seen
        if first:
            seen.add(t)
        out.append((i, keep, len(groups[t]), first, hashlib.sha256(t.encode()).hexdigest()))
    return out


def check(df, rows, **kw):
    got = [tuple(r) for r in exact_dedup(df, **kw).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


@pytest.mark.parametrize("t", ["", " ", "a", " a", "a ", "\n a\t\tb \x0b", "\u00a0 a", "a\x1cb"])
def test_normalise(t):
    assert normalise(t.encode()).decode() == re.sub(r"[\x20\x09-\x0D]+", " ", t)


def test_edges(edge, clash, empty, edge_rows):
    rows = [(r[0], r[1]) for r in edge_rows]
    check(edge, rows)
    check(clash, rows)
    check(empty, [])


def test_many_levels_and_a_hot_text(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 70))) for _ in range(40)] + ["ab" * 40, "ab" * 40 + "a"]
    rows = [(i, texts[-2] if i % 3 == 0 else rng.choice(texts)) for i in range(200)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows, block_bytes=4)
