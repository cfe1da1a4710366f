import itertools
import random
import textwrap

from boxpace.llm import licenses as L


def test_wording_diff_is_minimal():
    def brute(t, b):
        best = None
        for s, e in itertools.combinations_with_replacement(range(len(b) + 1), 2):
            x = b[s:e]
            d = [[i + j if not i * j else 0 for j in range(len(x) + 1)] for i in range(len(t) + 1)]
            for i in range(1, len(t) + 1):
                for j in range(1, len(x) + 1):
                    d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] if t[i - 1] == x[j - 1] else 99)
            best = min(best, d[-1][-1]) if best is not None else d[-1][-1]
        return best
    rng = random.Random(3)
    for _ in range(300):
        t, b = ([rng.choice("abc") for _ in range(rng.randint(0, 6))] for _ in range(2))
        n, s, e = L.wording_diff(t, b)
        assert n == brute(t, b)
        assert 0 <= s <= e <= len(b)
        assert brute(t, b[s:e]) == n


def test_every_template_is_found_in_its_place(spark):
    rows = [(i, f"Some words before it.\nHere: {t} And more words that follow it in the line.\nEnd.") for i, (_, t) in enumerate(L.TEMPLATES)]
    out = {r["doc_id"]: r for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, t) in enumerate(L.TEMPLATES):
        if not any(c in t.lower() for c in L.CUES):
            continue
        r = out[i]
        assert (r["license"], r["line_no"], r["n_diff"]) == (name, 1, 0), t
        assert r["start_word"] == 1 and r["end_word"] == 1 + len(L.words_of(t))


def test_versions_are_told_apart_and_others_left_alone(spark):
    rows = [(1, "This work is licensed under the GNU General Public License, version 2."),
            (2, "This work is licensed under the GNU General Public License, version 3!"),
            (3, "Her licence to drive was lost, and so was the permission to enter the harbour by night."),
            (4, "Licensed under CC BY-SA 4.0"), (5, "Licensed  under\tCC BY 4.0."), (6, "released UNDER the mit licenses")]
    out = {r["doc_id"]: r["license"] for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: "GPL-2.0", 2: "GPL-3.0", 4: "CC-BY-SA-4.0", 5: "CC-BY-4.0", 6: "MIT"}


def test_long_lines_are_scanned_whole(spark):
    fill = " ".join(f"word{i}" for i in range(700))
    rows = [(1, f"{fill} Released under the MIT License. {fill} Licensed under CC BY-NC 4.0. {fill}")]
    out = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["license"], r["start_word"]) for r in out] == [("MIT", 700), ("CC-BY-NC-4.0", 1405)]


def test_edges(spark, edge, clash, empty, edge_rows):
    for df in (edge, clash, empty):
        assert L.scan_licenses(df).count() == 0
    text = "Released under the MIT License."
    rows = [(None, text), (1, text), (1, text), (2, f"{text}\n{text}"), (3, None)]
    out = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["line_no"]) for r in out) == [("1", 0), ("1", 0), ("2", 0), ("2", 1), ("None", 0)]
    assert {r["block"] for r in out} == {text}


def test_query_finds_the_lines_of_the_table(spark):
    from boxpace.llm.catalog import op4_license_scan
    sf = "/root/testdata/sf0.01"
    want = set()
    names = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want |= {(r["doc_id"], k, names[x]) for k, x in enumerate(r["text"].split("\n")) if x in names}
    got = {(r["doc_id"], r["line_no"], r["license"]) for r in op4_license_scan(spark, sf).where("n_diff = 0").collect()}
    assert got == want


def test_every_place_of_a_block_is_found(spark):
    both = "Licensed under the Apache License, Version 2.0. Portions are released under the MIT License."
    every = " and then ".join(t for _, t in L.TEMPLATES)
    # Words of all long templates around a short wording, which save more bytes than it does.
    noise = [w for _, t in L.TEMPLATES if len(t) > 60 for w in L.words_of(t)]
    random.Random(5).shuffle(noise)
    prose = " ".join(noise[:110]) + " Licensed under CC BY 4.0. " + " ".join(noise[110:220])
    rows = [(1, both), (2, every), (3, prose), (4, " ".join([both] * 300))]
    out = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "start_word").collect()
    names = {i: [r["license"] for r in out if r["doc_id"] == i] for i in range(1, 5)}
    assert names[1] == ["Apache-2.0", "MIT"]
    assert names[2] == [n for n, _ in L.TEMPLATES]
    assert all(r["n_diff"] == 0 for r in out if r["doc_id"] in (1, 2, 4))
    assert "CC-BY-4.0" in names[3]
    assert names[4] == ["Apache-2.0", "MIT"] * 300


def test_hard_wrapped_wordings_are_found(spark):
    rows, want = [], []
    for width in (48, 72):
        for sign in ("", "# ", " * ", "// "):
            for name, t in L.TEMPLATES:
                lines = textwrap.wrap(t, width)
                i = len(rows)
                rows.append((i, "\n".join(["first line", *(sign + x for x in lines), "", "last line"])))
                want.append((i, name, 1, 0, "\n".join(sign + x for x in lines)))
    out = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "line_no").collect()
    assert [(r["doc_id"], r["license"], r["line_no"], r["n_diff"], r["block"]) for r in out] == want
    assert all((r["start_word"], r["end_word"]) == (0, r["n_words"]) for r in out)


def test_license_files(spark):
    mit = """MIT License

Copyright (c) 2020 Some Body. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
    bsd = """Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
    rows = [(1, mit), (2, bsd), (3, "Copyright 2020 Some Body.\nAll rights\nreserved."),
            (4, "Released into the public\ndomain: This is free and unencumbered software released into the public\ndomain.")]
    out = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "line_no").collect()
    got = [(r["doc_id"], r["license"], r["line_no"], r["n_diff"]) for r in out]
    assert got == [(1, "MIT", 4, 0), (2, "BSD-2-Clause", 3, 0), (2, "BSD-3-Clause", 6, 0), (3, "Proprietary", 1, 1),
                   (4, "Unlicense", 1, 0)]


def test_wordings_across_window_edges(spark):
    long = max((t for _, t in L.TEMPLATES), key=len)
    rows = [(k, "\n".join(textwrap.wrap(" ".join(f"w{i}" for i in range(k)) + f" {long} " + "end " * 300, 60)))
            for k in range(60, 300, 7)]
    out = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_diff"], r["license"]) for r in out] == [(k, 0, "GPL-3.0") for k, _ in rows]


class EveryTemplate(L.Scanner):
    """Brute force: every template is aligned with every block, whatever it saves."""

    def winners(self, block, ks):
        return ks


def mutated(rng, words, limit, vocabulary):
    t = list(words)
    for _ in range(rng.randint(0, limit)):
        if rng.random() < .5 and len(t) > 1:
            t.pop(rng.randrange(len(t)))
        else:
            t.insert(rng.randrange(len(t) + 1), rng.choice(vocabulary) if rng.random() < .5 else "".join(rng.choices("abcdefgh", k=9)))
    return t


def test_compression_leaves_no_place_out():
    scanner, every, rng = L.Scanner(L.TEMPLATES, 25), EveryTemplate(L.TEMPLATES, 25), random.Random(9)
    vocabulary = sorted(scanner.vocabulary)
    n = 0
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 5)):
            k = rng.randrange(len(scanner.templates))
            words += [rng.choice(vocabulary) if rng.random() < .1 else "".join(rng.choices("abcdefghij", k=rng.randint(1, 8)))
                      for _ in range(rng.randint(0, 70))]
            words += mutated(rng, scanner.templates[k][1], scanner.limits[k], vocabulary)
        want = every.places(words, 0.0)
        assert scanner.places(words, 0.0) == want
        n += len(want)
    assert n > 200


def test_table_equals_brute_force(spark):
    from boxpace.llm.catalog import op4_license_scan
    sf, every, want = "/root/testdata/sf0.01", EveryTemplate(L.TEMPLATES, 25), []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("text is not null").toLocalIterator():
        if any(c in r["text"].lower() for c in L.CUES):
            words, at = L.words_of_lines(r["text"].split("\n"), every.vocabulary)
            want += [(r["doc_id"], *at[h[4]], *h[:4]) for h in every.places(words, 0.0)]
    got = op4_license_scan(spark, sf).select("doc_id", "line_no", "start_word", "license", "reduction", "n_diff", "n_words").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_places_come_through_the_compression(monkeypatch):
    words = L.words_of("Some text. " + " and then ".join(t for _, t in L.TEMPLATES))
    want = L.Scanner(L.TEMPLATES, 25).places(words, 0.0)
    assert [h[0] for h in want] == [n for n, _ in L.TEMPLATES]
    for saved in (0, 50):  # a compressor that knows nothing finds nothing, or the wrong templates
        monkeypatch.setattr(L.Scanner, "sizes", lambda self, block, ks, saved=saved: (100, [saved for _ in ks]))
        assert [h[0] for h in L.Scanner(L.TEMPLATES, 25).places(words, 0.0)] != [h[0] for h in want]


def test_very_long_texts_and_words(spark):
    fill = "x" * 300_000 + " " + " ".join(f"w{i % 977}" for i in range(150_000))
    rows = [(1, f"{fill} Released under the MIT License. {fill}")]
    out = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["license"], r["start_word"], r["n_diff"]) for r in out] == [("MIT", 150_001, 0)]
