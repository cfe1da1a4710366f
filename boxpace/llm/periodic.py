"""Periodic runs of words, found by common extensions over a difference cover (operator 13).

A run is a maximal stretch of words with a period that it holds three times or more. Candidates come from a
*harmonic grid*: for every period p, places a step of about p apart; a place i whose words agree with those p
further on lies in a run, and the longest common extensions of (i, i + p) to the right and to the left are its
ends.

Extensions are answered by an index over a *difference cover* D modulo V: for any two places some shift below V
moves both onto places whose remainders are in D. Only suffixes at those places are sorted. A query compares the
few words up to the shift; if they agree, the rest is the smallest common prefix between the two
suffixes' ranks, from a sparse table.

Texts are handled in chunks of about CHUNK_WORDS words with a word of its own after each text, so one NumPy call works
on many short texts and nothing reaches across two. A text is never cut.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

# A perfect difference cover: every remainder modulo 31 is a difference of two of its six members.
V = 31
COVER = (1, 5, 11, 24, 25, 27)
CHUNK_WORDS = 1 << 16
QUERIES = 1 << 20
# A grid place in a run has this many words at least that equal those one period on.
SURE_WORDS = 8


def ranks_of(keys):
    """Dense ranks, equal for equal keys."""
    import numpy as np
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


class Extensions:
    """Longest common extensions to the right in ``words`` (non-negative int64), by a difference cover.

    No two suffixes agree up to the end of ``words``: callers end it with a word that stands nowhere else.
    """

    def __init__(self, words):
        import numpy as np
        n = len(words)
        self.n = n
        # Past the end there are V words that stand nowhere else.
        top = int(words.max()) + 1
        self.words = np.concatenate([words, top + np.arange(2 * V)])
        shift = np.full((V, V), -1, dtype=np.int64)
        for s in range(V - 1, -1, -1):
            r = np.array([(c - s) % V for c in COVER])
            shift[r[:, None], r[None, :]] = s
        self.shift = shift
        at = np.arange(n + V)
        self.sample = at[np.isin(at % V, COVER)]
        self.place = np.zeros(n + V, dtype=np.int64)  # of a sampled suffix among the samples by position
        self.place[self.sample] = np.arange(len(self.sample))
        self._sort()
        self._table()

    def _sort(self):
        """Order of the sampled suffixes: ranks of their first V words, doubled until all differ."""
        import numpy as np
        blocks = self.words[self.sample[:, None] + np.arange(V)]
        # Ranks of V words: pairs of ranks are ranked again until one rank stands for all.
        while blocks.shape[1] > 1:
            if blocks.shape[1] % 2:
                blocks = np.concatenate([blocks, np.zeros((len(blocks), 1), dtype=np.int64)], axis=1)
            pairs = blocks[:, 0::2] * (int(blocks.max()) + 1) + blocks[:, 1::2]
            blocks = ranks_of(pairs.ravel()).reshape(pairs.shape)
        rank = ranks_of(blocks[:, 0])
        self.levels = [rank]
        step = V
        while len(rank) and rank.max() + 1 < len(rank):
            after = self.sample + step
            inside = after < self.n + V
            follow = np.zeros(len(rank), dtype=np.int64)
            follow[inside] = rank[self.place[after[inside]]] + 1
            rank = ranks_of(rank * (len(rank) + 2) + follow)
            self.levels.append(rank)
            step *= 2
        self.rank = rank

    def _table(self):
        """Sparse table of the common prefixes of neighbours in the order."""
        import numpy as np
        m = len(self.sample)
        order = np.empty(m, dtype=np.int64)
        order[self.rank] = np.arange(m)
        a, b = self.sample[order[:-1]].copy(), self.sample[order[1:]].copy()
        common = np.zeros(max(0, m - 1), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            live = np.flatnonzero((a < self.n + V) & (b < self.n + V))
            same = live[self.levels[k][self.place[a[live]]] == self.levels[k][self.place[b[live]]]]
            common[same] += V << k
            a[same] += V << k
            b[same] += V << k
        common += self._compare(a, b, np.full(len(a), V))
        self.table = [common]
        k = 1
        while 2 * k <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-k], last[k:]))
            k *= 2

    def _compare(self, a, b, most):
        """Words that agree from a and b on, ``most`` of them at most, one by one."""
        import numpy as np
        out = np.zeros(len(a), dtype=np.int64)
        live = np.arange(len(a))
        for s in range(int(most.max()) if len(a) else 0):
            live = live[most[live] > s]
            x, y = a[live] + s, b[live] + s
            inside = np.maximum(x, y) < len(self.words)
            live = live[inside][self.words[x[inside]] == self.words[y[inside]]]
            if not len(live):
                break
            out[live] = s + 1
        return out

    def common(self, a, b):
        """Longest common prefixes of the suffixes at ``a`` and ``b`` (arrays, a != b)."""
        import numpy as np
        shift = self.shift[a % V, b % V]
        out = self._compare(a, b, shift)
        on = np.flatnonzero(out == shift)
        on = on[(np.maximum(a, b)[on] + shift[on]) < self.n + V]
        x, y = self.rank[self.place[a[on] + shift[on]]], self.rank[self.place[b[on] + shift[on]]]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        least = np.empty(len(on), dtype=np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            t = self.table[k]
            least[at] = np.minimum(t[lo[at]], t[hi[at] - (1 << k)])
        out[on] += least
        return out


def grid(lengths, starts, min_words: int, min_repeats: int):
    """Yield (text, place, period) arrays: the harmonic grid of every text and period, in blocks of about QUERIES.

    A run of period p has max(min_words - p, (min_repeats - 1) * p) places with an equal word p on; the step is half
    of that, so one of its grid places has as many equal words to its right.
    """
    import numpy as np
    lengths = np.asarray(lengths, dtype=np.int64)
    longest = np.where(lengths >= min_words, lengths // min_repeats, 0)
    text = np.repeat(np.arange(len(lengths)), longest)
    period = np.arange(len(text)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    step = np.maximum(1, np.maximum(min_words - period, (min_repeats - 1) * period) // 2)
    n = -(-(lengths[text] - period) // step)
    ends = np.cumsum(n)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + QUERIES, side="right")))
        m = n[a:b]
        owner = np.repeat(np.arange(a, b), m)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
        yield text[owner], starts[text[owner]] + number * step[owner], period[owner]
        a = b


def find_runs(word_ids: list, min_words: int = 24, min_repeats: int = 3) -> list:
    """Per text (an int64 array of word numbers) its runs as sorted (start, length, period) rows.

    A run is a stretch of words of smallest period q, of max(min_words, min_repeats * q) words or more, that no
    neighbouring word extends keeping the period.
    """
    import numpy as np
    lengths = np.array([len(w) for w in word_ids], dtype=np.int64)
    none = np.zeros((0, 3), dtype=np.int64)
    out = [none] * len(word_ids)
    if not lengths.sum():
        return out
    # One word of its own before the first text and after each.
    top = max(int(w.max()) for w in word_ids if len(w)) + 1
    starts = np.cumsum(lengths + 1) - lengths
    words = np.empty(int(lengths.sum()) + len(lengths) + 1, dtype=np.int64)
    words[0] = top + len(lengths)
    for k, w in enumerate(word_ids):
        words[starts[k]:starts[k] + len(w)] = w
        words[starts[k] + len(w)] = top + k
    sure = min(SURE_WORDS, max(1, min((max(min_words - p, (min_repeats - 1) * p) // 2 for p in range(1, min_words + 1)))))
    index = {}
    found = [np.zeros((0, 3), dtype=np.int64)]
    for _, i, p in grid(lengths, starts, min_words, min_repeats):
        for s in range(sure):
            same = words[i + s] == words[i + s + p]
            i, p = i[same], p[same]
        if not len(i):
            continue
        if not index:
            index = {"right": Extensions(words), "left": Extensions(words[::-1])}
        stop = i + p + index["right"].common(i, i + p)
        begin = i - index["left"].common(len(words) - i - p, len(words) - i)
        long = stop - begin >= np.maximum(min_words, min_repeats * p)
        rows = np.stack([begin[long], stop[long], p[long]], axis=1)
        # A multiple of the smallest period has the same ends: the smallest one comes first.
        rows = np.concatenate([*found, rows])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        found = [rows[new]]
    rows = found[0]
    owner = np.searchsorted(starts, rows[:, 0], side="right") - 1
    cuts = np.searchsorted(owner, np.arange(len(word_ids) + 1))
    for k in np.unique(owner):
        r = rows[cuts[k]:cuts[k + 1]]
        r = np.stack([r[:, 0] - starts[k], r[:, 1] - r[:, 0], r[:, 2]], axis=1)
        out[k] = r[np.lexsort((r[:, 2], r[:, 0]))]
    return out


def greatest(runs) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period; ties by smallest start, then period (the rows' order)."""
    best = None
    for start, length, period in runs:
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def collapse(words: list, runs) -> list:
    """The words without those that a run contains after its first period."""
    import numpy as np
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def periodic_runs(docs: DataFrame, min_words: int = 24, min_repeats: int = 3, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>>, best struct, collapsed string) of every row.

    Words are maximal stretches without space and U+0009 to U+000D, numbered from 0 over the whole text. ``runs`` is
    sorted by start, then period; ``best`` is the run of greatest exact length / period (ties: smallest start, then
    period), NULL without a run; ``collapsed`` joins by one space the words that no run contains after its
    first period. NULL, empty and blank texts have no words, no runs and the empty string. Repeated rows give
    a row each, a NULL doc_id stays NULL, an empty table gives no rows, very long texts are searched whole, other
    columns are not read.
    """
    if min_repeats < 2 or min_words < 2:
        raise ValueError("a run needs two repeats and two words")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

        def answer(ids, split):
            number: dict[bytes, int] = {}
            coded = [np.fromiter((number.setdefault(w, len(number)) for w in ws), dtype=np.int64, count=len(ws))
                     for ws in split]
            every = find_runs(coded, min_words, min_repeats)
            found = [r.tolist() for r in every]
            best = [greatest(r) for r in found]

            def struct(rows):
                cols = list(zip(*rows)) if rows else [(), (), ()]
                return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], fields=list(run_type))
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])])
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct([x for r in found for x in r]))
            one = pa.array([None if b is None else dict(zip(("start", "length", "period"), b)) for b in best], run_type)
            text = pa.array([b" ".join(collapse(ws, r)) for ws, r in zip(split, every)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), runs, one, text.cast(pa.string())],
                                              names=["doc_id", "runs", "best", "collapsed"])
        for b in batches:
            ids, split, held = [], [], 0
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                ids.append(i)
                split.append(raw.split())  # bytes: splits at exactly these six characters
                held += len(split[-1])
                if held >= CHUNK_WORDS:
                    yield answer(ids, split)
                    ids, split, held = [], [], 0
            if ids:
                yield answer(ids, split)
    row = "struct<start: long, length: long, period: long>"
    return texts(docs, id_col, text_col).mapInArrow(
        run, f"doc_id long, runs array<{row}>, best {row}, collapsed string")


def plant_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the contract's periodic texts: one document in ten repeats its own words from some place on.

    With h = crc32 of the decimal id, g = h div 10 and n words: where h mod 10 is 0 and n > 0, word i >= a becomes
    word a + (i - a) mod p of the text, a = g mod n, p = 1 + (n - a) div (3 + g mod 8). Such a text's words are
    joined by one space. Other texts, and rows without id, stay as they are. Only id and text are returned.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                    F.floor(h / 10).cast("long").alias("_g"), F.when(h % 10 == 0, words).alias("_w"))
    n = F.size("_w").cast("long")
    a: Column = F.col("_g") % n
    d = d.withColumn("_a", F.when(n > 0, a.cast("int")))
    p = F.lit(1) + F.floor((n - F.col("_a")) / (F.lit(3) + F.col("_g") % 8)).cast("int")
    d = d.withColumn("_p", p)
    turned = F.transform(F.slice("_w", F.col("_a") + 1, F.size("_w")), lambda w, i: F.get(
        F.col("_w"), F.col("_a") + i % F.col("_p")))
    text = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), turned), " ")
    return d.select("doc_id", F.when(F.col("_a").isNotNull(), text).otherwise(F.col("text")).alias("text"))
