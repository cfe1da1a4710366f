"""License scans by conditional compression (operator 4).

Documents that mention licensing are read as one sequence of words, across their lines, in blocks about twice
as long as a template's places, overlapping by half. A block that holds enough words of a template is a candidate.
It is compressed with zstandard, once without help and once with each template of its size as a raw dictionary. Wording
that is shared leaves little to write: templates that save a share of what they save on themselves are the winners of the
block. Their places are confirmed and delimited by exact wording, the words to insert or delete. Of places that
overlap, the one whose template saves most counts; it is cut out, and what is left is searched again.
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_BATCH_BYTES, texts

# Public wordings, one line each: (license id, template).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# A document is a candidate if it holds one of these, whatever its case; their words may be on two lines.
CUES = ("licen", "copyright", "rights reserved", "permission", "redistribution", "public domain", "creative commons",
        "spdx", "copyleft", "free software")
# Blocks have this many words or twice, four times ... as many.
BLOCK_WORDS = 16
# The share of the bytes a template saves on itself that it must save on a block to be looked for there.
MIN_SHARE = 0.1
# The license whose wording, short of a word, is part of the copyright line of others.
RESERVED = "Proprietary"


def words_of(text: str) -> list[str]:
    import re
    return re.findall(r"\w+(?:[.-]\w+)*", text.lower())


def words_of_lines(lines: list[str], vocabulary: set[str]) -> tuple[list[str], list[tuple[int, int]]]:
    """(words, (line, place in the line) of each) of the lines in turn.

    The halves of a word parted by a hyphen at the end of a line are one word if that is in ``vocabulary``.
    """
    words, at, parted = [], [], False
    for no, line in enumerate(lines):
        found = words_of(line)
        for i, w in enumerate(found):
            if i == 0 and parted:
                whole = next((x for x in (words[-1] + w, f"{words[-1]}-{w}") if x in vocabulary), None)
                if whole:
                    words[-1] = whole
                    continue
            words.append(w)
            at.append((no, i))
        if found:
            end = line.rstrip()
            parted = end[-1:] == "-" and end[-2:-1].isalnum()
    return words, at


def alignments(template: list[str], block: list[str]) -> tuple[list[int], list[int]]:
    """(cost, start) for every end in ``block``: fewest words to insert or delete to turn the template into block[start:end]."""
    cost, start = [0] * (len(block) + 1), list(range(len(block) + 1))
    for i, t in enumerate(template, 1):
        prev, prev_start = cost, start
        cost, start = [i], [0]
        for j, w in enumerate(block, 1):
            best = (prev[j] + 1, prev_start[j])
            if cost[j - 1] + 1 < best[0]:
                best = (cost[j - 1] + 1, start[j - 1])
            if t == w and prev[j - 1] <= best[0]:
                best = (prev[j - 1], prev_start[j - 1])
            cost.append(best[0])
            start.append(best[1])
    return cost, start


def wording_diff(template: list[str], block: list[str]) -> tuple[int, int, int]:
    """(differences, start, end): fewest words to insert or delete to turn the template into a stretch of ``block``.

    An alignment whose ends in the block are free; among equal ones the first to end counts.
    """
    cost, start = alignments(template, block)
    end = min(range(len(cost)), key=lambda j: cost[j])
    return cost[end], start[end], end


class Scanner:
    """Templates with their compressors, by the size of the blocks they are looked for in."""

    def __init__(self, templates: Iterable[tuple[str, str]], max_diff_pct: int, min_share: float = MIN_SHARE, level: int = 19):
        from collections import Counter, defaultdict

        import zstandard
        self.templates = [(name, w) for name, w in ((name, words_of(text)) for name, text in templates) if w]
        self.min_share = min_share
        self.counts = [Counter(w) for _, w in self.templates]
        self.vocabulary = {x for _, w in self.templates for x in w}
        self.limits = [max_diff_pct * len(w) // 100 for _, w in self.templates]
        # Words a confirmed place has at most, and letters of a word: longer words equal no template's.
        self.reach = max((len(w) + m for (_, w), m in zip(self.templates, self.limits)), default=0)
        self.letters = max(map(len, self.vocabulary), default=0) + 1
        raw = [zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
               for _, w in self.templates]
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.with_dict = [zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False) for d in raw]
        self.own = [self.sizes(w, [k])[1][0] for k, (_, w) in enumerate(self.templates)]
        by_size = defaultdict(list)
        for k, ((_, w), m) in enumerate(zip(self.templates, self.limits)):
            size = BLOCK_WORDS
            while size < 2 * (len(w) + m):
                size *= 2
            by_size[size].append(k)
        self.by_size = sorted(by_size.items())

    def sizes(self, block: list[str], ks: Iterable[int]) -> tuple[int, list[int]]:
        """(compressed size of the block, bytes that each template of ``ks`` saves on it as a dictionary)."""
        data = " ".join(w[:self.letters] for w in block).encode("utf-8", "replace")
        plain = len(self.plain.compress(data))
        return plain, [plain - len(self.with_dict[k].compress(data)) for k in ks]

    def winners(self, block: list[str], ks: list[int]) -> list[int]:
        """Templates of ``ks`` that save ``min_share`` or more of what they save on themselves, most bytes first.

        A block that has too few words of every template for a place within the limit is not compressed.
        """
        from collections import Counter
        have = Counter(w for w in block if w in self.vocabulary)
        if not any(sum(min(c, have[w]) for w, c in self.counts[k].items()) >= len(self.templates[k][1]) - self.limits[k]
                   for k in ks):
            return []
        saved = dict(zip(ks, self.sizes(block, ks)[1]))
        return sorted((k for k in ks if saved[k] > 0 and saved[k] >= self.min_share * self.own[k]), key=lambda k: (-saved[k], k))

    def confirmed(self, words: list[str]) -> list[tuple]:
        """(bytes saved, reduction, start, end, template, differences) of every confirmed place, most saved first.

        Those of one template don't overlap: the fewest differences, then the first, count. Blocks overlap
        by half and are twice a place's length or more, so each place is in one as a whole. Equal savings are
        ranked by the share of differences.
        """
        found: dict[int, set] = {}
        for size, ks in self.by_size:
            step = size // 2
            least = min(len(self.templates[k][1]) - self.limits[k] for k in ks)
            known = [w in self.vocabulary for w in words]
            for at in range(0, max(1, len(words) - step), step):
                if sum(known[at:at + size]) < least:
                    continue
                block = words[at:at + size]
                for k in self.winners(block, ks):
                    for end, (diff, start) in enumerate(zip(*alignments(self.templates[k][1], block))):
                        if diff <= self.limits[k] and end > start:
                            found.setdefault(k, set()).add((diff, start + at, end + at))
        out = []
        for k, stretches in found.items():
            taken: list[tuple[int, int]] = []
            for diff, start, end in sorted(stretches):
                if place_in(taken, start, end):
                    plain, (saved,) = self.sizes(words[start:end], [k])
                    out.append((saved, saved / plain, start, end, k, diff))
        out.sort(key=lambda h: (-h[0], h[5] / len(self.templates[h[4]][1]), h[2], h[3], h[4]))
        return out

    def places(self, words: list[str], min_reduction: float) -> list[tuple]:
        """(license, reduction, differences, template's words, start, end) of every place, by start; none overlap.

        The place whose template saves most comes first; it is cut out, and what is left before and after it is
        searched again, until nothing in it is confirmed. "All rights reserved" alone,
        no more words than ``reach`` from another license, is that license's copyright line and no place.
        """
        out, todo = [], [(0, len(words))]
        while todo:
            lo, hi = todo.pop()
            taken: list[tuple[int, int]] = []
            for _, gain, start, end, k, diff in self.confirmed(words[lo:hi]):
                if gain >= min_reduction and place_in(taken, start, end):
                    name, t = self.templates[k]
                    out.append((name, gain, diff, len(t), lo + start, lo + end))
            if taken:
                edges = [0, *(x for place in taken for x in place), hi - lo]
                todo += [(lo + a, lo + b) for a, b in zip(edges[::2], edges[1::2]) if a < b]
        out.sort(key=lambda h: h[4])
        others = [h[4:] for h in out if h[0] != RESERVED]

        def part_of_another(h):
            at = bisect_left(others, h[4:])
            return h[0] == RESERVED and h[2] and any(max(h[4] - end, start - h[5]) <= self.reach
                                                     for start, end in others[max(0, at - 1):at + 1])
        return [h for h in out if not part_of_another(h)]


def place_in(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Put (start, end) into the ordered list if it overlaps none there."""
    at = bisect_left(taken, (start,))
    if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
        return False
    taken.insert(at, (start, end))
    return True


def scan_licenses(docs: DataFrame, templates: Iterable[tuple[str, str]] = TEMPLATES, cues: Iterable[str] = CUES,
                  min_reduction: float = 0.0, max_diff_pct: int = 25, id_col: str = "doc_id",
                  text_col: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, line_no, license, reduction, n_diff, n_words, start_word, end_word, block): each place a license is found.

    A document with a cue is scanned as one sequence of words, so a wording may run over lines, with comment signs
    or without, in overlapping blocks however long it is. A template is looked for in a block if it saves there
    ``min_share`` or more of the bytes it saves on itself, and a place is confirmed if at most ``max_diff_pct`` per cent of
    the template's words are inserted or deleted. Of places that overlap, the one that saves most bytes
    counts, then the one with the smallest share of differences; ``min_reduction`` leaves out places reduced by less.
    ``reduction`` is the share of the place's compressed size that the template saves. Other columns are not read.
    A NULL or empty text gives no rows; NULL ids stay NULL, repeated rows are
    scanned each, and so are repeated lines. ``line_no`` is the line a place starts in, from 0; ``start_word`` counts
    from 0 within that line, ``end_word`` goes on over the lines that follow; ``block`` has the place's lines.
    """
    templates, cues = tuple(templates), tuple(tuple(c.lower().split()) for c in cues)

    def run(batches):
        import pyarrow as pa
        scanner = Scanner(templates, max_diff_pct, min_share)
        names = ["doc_id", "line_no", "license", "reduction", "n_diff", "n_words", "start_word", "end_word", "block"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)
        for b in batches:
            out, held = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                low = text.lower()
                if not any(all(w in low for w in c) for c in cues):
                    continue
                lines = text.split("\n")
                words, at = words_of_lines(lines, scanner.vocabulary)
                for name, gain, diff, n_words, start, end in scanner.places(words, min_reduction):
                    no, first = at[start]
                    block = "\n".join(lines[no:at[end - 1][0] + 1])
                    out.append((doc_id, no, name, gain, diff, n_words, first, first + end - start, block))
                    held += len(block)
                    if held > ARROW_BATCH_BYTES:  # many places in a long line
                        yield batch(out)
                        out, held = [], 0
            yield batch(out)
    return texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, line_no long, license string, reduction double, n_diff long, n_words long, "
             "start_word long, end_word long, block string")
