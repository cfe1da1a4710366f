import random
import re
from collections import Counter

from boxpace.llm import quality as Q

COLS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines",
        "n_bad_lines", "n_lost_words", "kept", "clean_text"]
PHRASES = ["all rights reserved", "accept cookies", "cookie policy", "enable javascript", "javascript is disabled",
           "privacy policy", "terms of service", "terms of use", "subscribe to our newsletter", "share on facebook",
           "back to top", "skip to content", "lorem ipsum"]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def bad(line):
    n = len(words(line))
    count = lambda chars: sum(line.count(c) for c in chars)
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
    return ((n >= 3 and not count(".!?。！？؟।…")) or (count("#*$%&<>") >= 3 and 2 * count("#*$%&<>") > n)
            or (count("!") >= 3 and count("!") >= n) or (count("|»›·•") >= 3 and 4 * count("|»›·•") >= n)
            or any(p in low for p in PHRASES))


def brute(i, t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    at = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    rep = {p for k in range(len(w) - 7) if at[tuple(w[k:k + 8])] > 1 for p in range(k, k + 8)}
    failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
    lost = [x for x in lines if bad(x)]
    n_lost = sum(len(words(x)) for x in lost)
    return (i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), failed,
            len(lines), len(lost), n_lost, not failed and 100 * n_lost <= 50 * len(w), "\n".join(x for x in lines if not bad(x)))


def check(df, rows):
    got = [tuple(r) for r in Q.quality(df).select(*COLS).collect()]
    assert sorted(map(repr, got)) == sorted(repr(brute(i, t)) for i, t in rows)


def test_edges(edge, clash, empty, edge_rows):
    rows = [(r[0], r[1]) for r in edge_rows]
    check(edge, rows)
    check(clash, rows)
    check(empty, [])


def test_random_texts(spark):
    rng = random.Random(8)
    vocab = ["a", "bb", "Word.", "x###", "|", "HOME!!", "$$$", "Privacy", "Policy", "»", "no", "yes?", " ", "ü"]
    rows = []
    for i in range(250):
        lines = [" ".join(rng.choice(vocab[:rng.randint(1, 14)]) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(0, 8))]
        lines += rng.choices(lines, k=rng.randint(0, 4)) if lines else []
        rows.append((i, rng.choice(["\n", "\n\n", " \t\n"]).join(lines)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_junk_goes_and_prose_stays(spark):
    prose = ". ".join(" ".join(f"w{(i * j) % 97}x{i}" for j in range(12)) for i in range(8)) + "."
    junk = {
        "menu": "\n".join(" | ".join(f"page{i}{j}" for j in range(9)) for i in range(6)),
        "symbols": " ".join(f"word{i}%%%" for i in range(60)),
        "shouting": " ".join(f"BUY{i}!!" for i in range(60)),
        "legal": ("Read the privacy policy. " + " ".join(f"v{i}" for i in range(40))),
        "loop": "round and round it goes again and again. " * 20,
    }
    rows = [("prose", prose), ("mixed", prose + "\nhome | about | contact | help"), *junk.items()]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    kept = {rows[r["doc_id"]][0] for r in Q.quality(df).where("kept").collect()}
    assert kept == {"prose", "mixed"}


def test_plan_is_native(edge):
    plan = Q.quality(edge)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
