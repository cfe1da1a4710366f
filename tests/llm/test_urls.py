import itertools
import random

import pytest

from boxpace.llm.catalog import URL_RULES
from boxpace.llm.urls import RuleTrie, filter_urls


def brute(rules, host, path):
    fits = [(h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h) or not h) and path.startswith(p)]
    key = lambda r: (r[0].count(".") + 1 if r[0] else 0, len(r[1]), r[2] == "block")
    best = max(fits, key=key, default=None)
    return best and (best[0] + best[1], best[2])


def test_trie_equals_all_rules():
    rng = random.Random(5)
    labels, segs = ["a", "b", "com", "net"], ["", "x", "xy", "en"]
    hosts = [".".join(h) for n in (1, 2, 3) for h in itertools.product(labels, repeat=n)]
    paths = ["", "/"] + ["/" + "/".join(p) for n in (1, 2, 3) for p in itertools.product(segs, repeat=n)]
    for _ in range(60):
        rules = [(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(rng.randint(0, 25))]
        trie = RuleTrie(rules)
        for _ in range(80):
            host, path = rng.choice(hosts), rng.choice(paths)
            assert trie.find(host, path) == brute(rules, host, path), (rules, host, path)


def test_rules_are_checked():
    with pytest.raises(ValueError):
        RuleTrie([("a", "/", "maybe")])


URLS = [
    ("http://Example.COM/en/1", "example.com", "/en/1", "example.com/en/", "block"),
    ("http://m.www.example.com/en/?q", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://example.com?x=/en/", "example.com", "", None, "allow"),
    ("http://example.com/en#/", "example.com", "/en", "com/", "allow"),
    ("http://a.net/es/x", "a.net", "/es/x", "net/es/", "block"),
    ("http://notnet/es/x", "notnet", "/es/x", None, "allow"),
    ("http://a.com://b.net/fr/", "a.com:", "//b.net/fr/", None, "allow"),
    ("//a.net/fr/", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("x\n://A\u00c9.net/fr/", "a\u00c9.net", "/fr/", "net/fr/", "block"),
]


def test_contract(spark):
    rows = [(i if i else None, u, "x", "y") for i, (u, *_) in enumerate(URLS)] + [(1, URLS[1][0], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = filter_urls(pages, URL_RULES).collect()
    want = [(i if i else None, *u[1:]) for i, u in enumerate(URLS)] + [(1, *URLS[1][1:])]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert filter_urls(pages.where("false"), URL_RULES).count() == 0
    assert [r["verdict"] for r in filter_urls(pages, [], default="block").collect()] == ["block"] * len(rows)
