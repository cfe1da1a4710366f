import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Null ids, texts and sources, empty and blank texts, repeated rows, shared ids, a very long text."""
    rng = random.Random(3)
    base = prose(rng, 60)
    line = "This line stands in very many of the documents here."
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (2, prose(rng, 30), "en", None),
        (3, None, None, "b"), (4, "", "en", "b"), (5, " \t\n", "en", "b"), (None, base, "en", "a"),
        (None, None, None, None), (None, "one two", "en", "c"), (6, "one  two", "en", "c"), (7, " one two ", "en", "c"),
        (8, base.replace(" ", "\n", 3).upper(), "en", "a"), (9, prose(rng, 4000) + "\n" + " " * 9000 + "x" * 9000, "en", "a"),
        (10, base + " tail", "fr", "a"), (11, "!" * 50, "en", "c"), (12, "A\u00a0B\u2003c \U0001f600", "en", "c"),
    ]
    rows += [(20 + i, f"{prose(rng, 25)}.\n  {line.upper() if i % 2 else line}\t\n{line}", "en", "a") for i in range(7)]
    return [(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clash(edge):
    """The same rows with columns named like the operators' own."""
    names = ["n_tokens", "token_ids", "row", "value", "name", "level", "sha", "block", "cid", "label", "h1", "shard", "_drop",
             "score", "kept", "component_id", "_count", "replica", "weight", "n", "_l", "_key", "_d", "_id", "_class", "host"]
    return edge.withColumns({c: F.lit(c) for c in names})


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


def same_rows(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))
