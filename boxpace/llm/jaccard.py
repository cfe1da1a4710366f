"""N-gram Jaccard join (operator 8): documents whose shingle sets are alike, and their groups.

Sets of 64-bit shingle hashes are compared exactly. Documents with one and the same set
form a class, which is joined once. Two sets with a Jaccard similarity of t or more must
share one of the first (1 - t) of their shingles in any common order, so each class
sends only those to *tiles*:

1. Order: shingles found often in a fixed share of the documents come last, the rest by
   hash. The order decides how many candidates there are, never which links are found.
2. Tiles: the classes that share a shingle, sorted by set size and cut into bands of
   ``TILE`` members. A class meets its own band and, as a guest, earlier bands whose sizes
   are near enough; every band is a unit of work of its own.
   The place of the shared shingle in both orders bounds what can follow it, which rules
   out most pairs and all but a few meetings of the others.
3. Bitmaps: a class has a bitmap of its hashes, a few bits per shingle. Bits of one
   set missing from the other bound the overlap from above. Members of a tile without a partner within
   the bound go no further.
4. Exact check: the sorted arrays of the pairs left are intersected, streaming past one array per
   (class, salt).

First only each tile's leaders are paired with their followers; the links found give
groups. What is left in a tile are members of different groups; a pair is left to the tile of an earlier common
shingle where the first few of both orders show one. There a round of pairs that would join all groups of the tile that can be joined, at most one less than its
members, is checked and merges most of them; then every pair of the tiles that still lies between two groups.
So near copies cost a number of pairs in proportion to the tiles' members, and no pair that could join two groups is left out.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, shared_checkpoint, texts

SHINGLE_WORDS = 5
TILE = 2048
# One document in SAMPLE_RATE, by its hash, counts shingles for the order; those of SAMPLE_COUNT or more come last. Of
# them at most HOT_SHINGLES (9 bytes each) are broadcast.
SAMPLE_RATE, SAMPLE_COUNT = 6, 3
HOT_SHINGLES = 1 << 20
# Classes up to which the list of those in candidate pairs (8 bytes each) is broadcast.
MAX_BROADCAST_CLASSES = 1 << 20
# Least bits; bits per shingle and most bits of a bitmap.
MIN_BITS, TILE_BITS = 64, (8, 4096)
# Partners of a class that one task compares with it.
PARTNERS = 64
# Shingles of a class's order that tell a tile whether an earlier one has a pair too.
HEAD = 8
_P = 0x9E3779B97F4A7C15


class WordHasher:
    """64-bit hashes of all words of a text at once, A-Z lower-cased.

    A word's hash is a polynomial over random numbers for its bytes, modulo 2^64, taken from the
    text's running sum and shifted back to exponent 0, then mixed with the word's length. Texts are
    worked through in stretches cut at blanks; a word of more than half a
    stretch is hashed as bytes.
    """

    def __init__(self, stretch: int = 1 << 18):
        import numpy as np
        rng = np.random.default_rng(8)
        self.stretch = stretch
        self.table = rng.integers(1, 2 ** 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.table[65:91] = self.table[97:123]
        self.blank = np.zeros(256, dtype=bool)
        self.blank[[32, *range(9, 14)]] = True
        base = 0xD1342543DE82EF95
        self.up, self.down = (np.full(stretch + 1, x, dtype=np.uint64) for x in (base, pow(base, -1, 2 ** 64)))
        for p in (self.up, self.down):
            p[0] = 1
            np.multiply.accumulate(p, out=p)

    def __call__(self, text: bytes):
        import numpy as np
        buf, parts, at = np.frombuffer(text, dtype=np.uint8), [], 0
        while len(buf) - at > self.stretch:
            cut = np.flatnonzero(self.blank[buf[at + self.stretch // 2:at + self.stretch]])
            if len(cut):
                end = at + self.stretch // 2 + int(cut[-1])
                parts.append(self._short(buf[at:end]))
                at = end
            else:  # one word covers the second half of the stretch
                rest = np.flatnonzero(self.blank[buf[at:at + self.stretch // 2]])
                start = at + int(rest[-1]) + 1 if len(rest) else at
                parts.append(self._short(buf[at:start]))
                end = start + self.stretch // 2
                while end < len(buf) and not self.blank[buf[end]]:
                    stop = np.flatnonzero(self.blank[buf[end:end + self.stretch]])
                    end = end + int(stop[0]) if len(stop) else min(len(buf), end + self.stretch)
                parts.append(np.array([self._long(buf[start:end].tobytes())], dtype=np.uint64))
                at = end
        parts.append(self._short(buf[at:]))
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    def _long(self, word: bytes) -> int:
        import xxhash
        return xxhash.xxh3_64_intdigest(word.lower())

    def _short(self, buf):
        import numpy as np
        inside = np.concatenate(([False], ~self.blank[buf], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        run = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(self.table[buf] * self.up[:len(buf)], out=run[1:])
        h = (run[end] - run[start]) * self.down[start]
        h = (h ^ (h >> np.uint64(31)) ^ (end - start).astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(28)
        long = np.flatnonzero(end - start > self.stretch // 2)
        for i in long.tolist():
            h[i] = self._long(buf[start[i]:end[i]].tobytes())
        return h


def shingle_set(text: bytes, hasher: WordHasher, k: int = SHINGLE_WORDS):
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of a text.

    Words are runs of anything but space and U+0009 to U+000D, A-Z lower-cased. A text of
    fewer words gives one shingle of all of them, one without words none.
    """
    import numpy as np
    w = hasher(text)
    n = len(w)
    if not n:
        return w
    size = min(k, n)
    with np.errstate(over="ignore"):
        h = w[:n - size + 1].copy()
        for i in range(1, size):
            h *= np.uint64(_P)
            h += w[i:n - size + 1 + i]
        h += np.uint64(size * 0xD6E8FEB86659FD93 & (2 ** 64 - 1))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def class_of(hashes) -> int:
    """Signed 64-bit id of a shingle set."""
    import xxhash
    h = xxhash.xxh3_64_intdigest(hashes.tobytes())
    return h - (1 << 64) if h >> 63 else h


def bitmap(hashes, per_shingle: int, most: int) -> bytes:
    """A power of two of bits, ``per_shingle`` or more each within MIN_BITS to ``most``; bit = hash modulo width."""
    import numpy as np
    width = min(most, max(MIN_BITS, 1 << (per_shingle * len(hashes) - 1).bit_length()))
    bits = np.zeros(width, dtype=np.uint8)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(n, pos, i: int, pct: int):
    """Which of the sets sized ``n`` >= n[i] can be like set i, if the shingle they share is the first common one.

    ``pos`` is that shingle's place in each set's order: none before it is common, so the
    overlap is at most what is left from there on. Sizes must be near enough, too.
    """
    ni, left = int(n[i]), n - pos
    need = -(-pct * (n + ni) // (100 + pct))
    return (pct * n <= 100 * ni) & (left >= need) & (left[i] >= need)


def fold(words, n_words: int):
    """Bitmaps (rows of uint64) brought to fewer words: halves are joined by OR."""
    while words.shape[1] > n_words:
        half = words.shape[1] // 2
        words = words[:, :half] | words[:, half:]
    return words


def overlap_bound(a, na, rows, nb):
    """Largest possible overlap of set ``a`` (bitmap, size) with each set of ``rows`` (bitmaps, sizes)."""
    import numpy as np
    only_a = np.bitwise_count(a & ~rows).sum(axis=1, dtype=np.int64)
    only_b = np.bitwise_count(rows & ~a).sum(axis=1, dtype=np.int64)
    return np.minimum(na - only_a, nb - only_b)


def alike(overlap, na, nb, pct: int):
    """100 * overlap >= pct * union."""
    return 100 * overlap >= pct * (na + nb - overlap)


def common_shingles(docs: DataFrame):
    """(sorted shingles, rank of each): those frequent among a fixed share of all documents, rank = log2 of the count.

    Only the join's speed depends on the counts, never its result.
    """
    import numpy as np

    def count(batches):
        import pyarrow as pa
        words, seen = WordHasher(), set()
        for b in batches:
            parts = []
            for t in b.column(0).cast(pa.binary()).to_pylist():
                h = shingle_set(t, words)
                c = class_of(h)
                if c not in seen:
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(c)
                    parts.append(h)
            u, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"token": pa.array(u.view(np.int64)), "n": pa.array(n.astype(np.int32))})
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE_RATE)) == 0).select("text")
    top = (sample.mapInArrow(count, "token long, n int").groupBy("token").agg(F.sum("n").alias("n"))
           .where(F.col("n") >= SAMPLE_COUNT).orderBy(F.col("n").desc(), "token").limit(HOT_SHINGLES)
           .select("token", F.ceil(F.log2("n")).cast("byte").alias("rank")).toArrow())
    tokens = top.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], top.column("rank").to_numpy()[order]


def class_rows(docs: DataFrame, pct: int, hot) -> DataFrame:
    """(doc_id, cid, n, sig, prefix) of each document; the last two with the class's first row in a task.

    ``cid`` is NULL for an empty set. ``prefix`` packs the shingles that reach tiles as 64-bit integers.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa
        tokens, ranks = hot.value
        words, seen = WordHasher(), set()
        for b in batches:
            cids, sizes, sigs, prefixes = [], [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                h = shingle_set(t, words)
                n = len(h)
                sizes.append(n)
                c = class_of(h) if n else None
                cids.append(c)
                if not n or c in seen:
                    sigs.append(None)
                    prefixes.append(None)
                    continue
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(c)
                sigs.append(bitmap(h, *TILE_BITS))
                take = n - (pct * n + 99) // 100 + 1
                if len(tokens):
                    at = np.searchsorted(tokens, h).clip(max=len(tokens) - 1)
                    rank = np.where(tokens[at] == h, ranks[at], 0)
                    h = h[np.argsort(rank, kind="stable")]
                prefixes.append(h[:take].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()),
                 pa.array(prefixes, pa.binary())], names=["doc_id", "cid", "n", "sig", "prefix"])
    return docs.mapInArrow(run, "doc_id long, cid long, n int, sig binary, prefix binary")


def make_tiles(rows: DataFrame, pct: int, tile: int) -> DataFrame:
    """(token, tile, cid, n, pos, leader, guest) for shingles that two classes or more share.

    ``leader`` is the first class of the run of sizes a class can link to, NULL for the
    leader itself. Guests repeat a class in earlier bands of sizes it can link to.
    """
    def unpack(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            packed = b.column(2).to_pylist()
            t = np.frombuffer(b"".join(packed), dtype=np.int64)
            size = np.array([len(x) // 8 for x in packed], dtype=np.int64)
            at = pa.array(np.repeat(np.arange(b.num_rows), size))
            pos = np.arange(len(t)) - np.repeat(np.cumsum(size) - size, size)
            place = np.repeat(b.column(1).to_numpy().astype(np.int64) << 32, size) + pos
            yield pa.RecordBatch.from_arrays([pa.array(t), b.column(0).take(at), pa.array(place)], names=["token", "cid", "place"])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        schema = pa.schema([("token", pa.int64()), ("tile", pa.int32()), ("cid", pa.int64()), ("n", pa.int32()),
                            ("pos", pa.int32()), ("leader", pa.int64()), ("guest", pa.bool_())])
        out, opened, now = [], None, None  # rows to send, a shingle's first row until a second one comes, the shingle
        i, last, lead, lead_n, bands = 0, None, None, 0, []

        def rows():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return batch
        # Rows come by (shingle, size, class); what is kept of a shingle is a size for each of its bands.
        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            edge = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]]) if len(cols[0]) else np.zeros(0, dtype=np.int64)
            size = np.diff(np.r_[edge, len(cols[0])])
            # Shingles with one row, if it isn't at the batch's ends, have no tile.
            some = np.repeat((size > 1) | (edge == 0) | (edge + size == len(cols[0])), size)
            tok, cid, place = (c[some] for c in cols)
            for tok, cid, n, pos in zip(tok.tolist(), cid.tolist(), (place >> 32).tolist(), (place & 0xFFFFFFFF).tolist()):
                if tok != now:
                    opened, now, i, last, lead, lead_n, bands = None, tok, 0, None, None, 0, []
                if cid == last:
                    continue  # a class comes once per task that met it
                last = cid
                if i == 0 or 100 * lead_n < pct * n:
                    lead, lead_n = cid, n
                own = i // tile
                if i % tile == 0:
                    bands.append(0)
                bands[own] = n
                row = (tok, own, cid, n, pos, None if lead == cid else lead, False)
                if i == 0:
                    opened = row
                else:
                    if opened:
                        out.append(opened)
                        opened = None
                    out.append(row)
                i += 1
                k = own - 1
                while k >= 0 and 100 * bands[k] >= pct * n:
                    out.append((tok, k, cid, n, pos, None, True))
                    k -= 1
                if len(out) > 50_000:
                    yield rows()
        if out:
            yield rows()
    tokens = (rows.where(F.col("prefix").isNotNull()).select("cid", "n", "prefix")
              .mapInArrow(unpack, "token long, cid long, place long"))  # place: set size, then the shingle's place
    dealt = tokens.repartition("token").sortWithinPartitions("token", "place", "cid")
    return dealt.mapInArrow(run, "token long, tile int, cid long, n int, pos int, leader long, guest boolean")


def bounded_pairs(pairs: DataFrame, sigs: DataFrame, pct: int) -> DataFrame:
    """The (a, b) whose bitmaps allow enough overlap."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            na, nb = b.column(2).to_pylist(), b.column(4).to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(b.column(3).to_pylist(), b.column(5).to_pylist())):
                u, v = (np.frombuffer(z, dtype=np.uint64)[None, :] for z in (x, y))
                w = min(u.shape[1], v.shape[1])
                if alike(overlap_bound(fold(u, w)[0], na[i], fold(v, w), nb[i])[0], na[i], nb[i], pct):
                    keep.append(i)
            yield b.select([0, 1]).take(pa.array(keep, pa.int64()))
    a = sigs.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    c = sigs.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    j = pairs.join(a, "a").join(c, "b").select("a", "b", "na", "sa", "nb", "sb")
    return j.mapInArrow(run, "a long, b long")


def by_tile(handle):
    """mapInArrow body over rows sorted by (token, tile): ``handle(table, start, end)`` for each whole tile.

    ``handle`` returns rows of a tile; ``out(rows)`` of the pair (handle, out) makes them a batch.
    """
    one, out = handle

    def run(batches):
        import numpy as np
        import pyarrow as pa
        held = None

        def tiles(t, last):
            tok, til = t.column("token").to_numpy(), t.column("tile").to_numpy()
            starts = np.flatnonzero(np.r_[True, (tok[1:] != tok[:-1]) | (til[1:] != til[:-1])])
            ends = np.r_[starts[1:], len(tok)]
            stop = len(starts) if last else len(starts) - 1  # the last tile may go on
            cols = {c: t.column(c).to_numpy() for c in ("cid", "n", "pos", "label", "guest")}
            found = []
            for s, e in zip(starts[:stop].tolist(), ends[:stop].tolist()):
                if e - s > 1:
                    found += one({c: v[s:e] for c, v in cols.items()}, t, s)
            return out(t, found), t.slice(int(starts[stop])) if stop < len(starts) else None
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                batch, held = tiles(pa.concat_tables([held, t]).combine_chunks() if held is not None else t, False)
                yield batch
        if held is not None:
            yield tiles(held, True)[0]
    return run


def partners(c: dict, i: int, pct: int):
    """Rows of a tile after row i that are in another group and may link with it."""
    import numpy as np
    far = int(np.searchsorted(c["n"], 100 * int(c["n"][i]) // pct, side="right"))
    ok = may_link(c["n"][i:far].astype(np.int64), c["pos"][i:far], 0, pct) & (c["label"][i:far] != c["label"][i])
    return i + np.flatnonzero(ok)


def with_partners(members: DataFrame, pct: int) -> DataFrame:
    """The rows of ``members`` that have a partner in their tile; all of a tile come in one partition."""
    def one(c, t, s):
        import numpy as np
        keep = np.zeros(len(c["n"]), dtype=bool)
        for i in np.flatnonzero(~c["guest"]).tolist():
            js = partners(c, i, pct)
            if len(js):
                keep[i] = True
                keep[js] = True
        return (s + np.flatnonzero(keep)).tolist()

    def out(t, found):
        import pyarrow as pa
        picked = t.take(pa.array(found, pa.int64()))
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in picked.columns], names=picked.column_names)
    cols = ["token", "tile", "cid", "n", "pos", "guest", "label"]
    dealt = members.repartition("token", "tile").sortWithinPartitions("token", "tile", "n", "cid").select(*cols)
    return dealt.mapInArrow(by_tile((one, out)), dealt.schema)


def bounded_partners(c: dict, t, s: int, pct: int):
    """Yield (row, its partners): those of a tile's pairs whose bitmaps allow enough overlap."""
    import numpy as np
    n = c["n"].astype(np.int64)
    sigs = t.column("sig").slice(s, len(n)).to_pylist()
    folded = {}
    for i in np.flatnonzero(~c["guest"]).tolist():
        js = partners(c, i, pct)
        if not len(js):
            continue
        w = len(sigs[i]) // 8
        if w not in folded:  # rows are sorted by size, so all later ones are as wide or wider
            folded[w] = (i, np.concatenate([fold(np.frombuffer(x, dtype=np.uint64)[None, :], w) for x in sigs[i:]]))
        base, x = folded[w]
        js = js[alike(overlap_bound(x[i - base], int(n[i]), x[js - base], n[js]), int(n[i]), n[js], pct)]
        if len(js):
            yield i, js


def marked_members(members: DataFrame, pct: int) -> DataFrame:
    """The rows of ``members`` (with ``sig`` and ``head``) that have a partner within the bitmaps' bound; a tile comes in one partition."""
    def one(c, t, s):
        import numpy as np
        keep = np.zeros(len(c["n"]), dtype=bool)
        for i, js in bounded_partners(c, t, s, pct):
            keep[i] = True
            keep[js] = True
        return (s + np.flatnonzero(keep)).tolist()

    def out(t, found):
        import pyarrow as pa
        picked = t.take(pa.array(found, pa.int64())).combine_chunks()
        return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in picked.columns],
                                          names=picked.column_names)
    dealt = members.repartition("token", "tile").sortWithinPartitions("token", "tile", "n", "cid")
    dealt = dealt.select("token", "tile", "cid", "n", "pos", "guest", "label", "sig", "head")
    return dealt.mapInArrow(by_tile((one, out)), dealt.schema)


def tile_pairs(members: DataFrame, groups: DataFrame, pct: int, spanning: bool) -> DataFrame:
    """(a, b): pairs of different groups that the tiles' bounds allow.

    ``members`` are rows as :func:`marked_members` wrote them, whole tiles in a partition; labels of the groups are joined
    without moving them where the groups can be broadcast. ``head`` packs the first shingles of a class's order. A pair with a common one ahead of the tile's shingle is left to that one's tile, so most come from one tile.
    With ``spanning`` a tile gives only pairs that join two groups that its earlier pairs don't.
    """
    def one(c, t, s):
        import numpy as np
        before = [None] * len(c["n"])

        def ahead(k):
            if before[k] is None:
                head = np.frombuffer(t.column("head")[s + k].as_buffer(), dtype=np.int64)
                before[k] = frozenset(head[:c["pos"][k]].tolist())
            return before[k]
        cid, label, up, pairs = c["cid"].tolist(), c["label"].tolist(), {}, []

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x
        for i, js in bounded_partners(c, t, s, pct):
            for j in js.tolist():
                if spanning and root(label[i]) == root(label[j]) or not ahead(i).isdisjoint(ahead(j)):
                    continue
                if spanning:
                    up[root(label[i])] = root(label[j])
                pairs.append((min(cid[i], cid[j]), max(cid[i], cid[j])))
        return pairs

    def out(t, found):
        import pyarrow as pa
        return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in found], pa.int64()),
                                           "b": pa.array([p[1] for p in found], pa.int64())})
    small = groups.count() <= MAX_BROADCAST_CLASSES
    dealt = labelled(members, groups, small)
    if not small:
        dealt = dealt.repartition("token", "tile").sortWithinPartitions("token", "tile", "n", "cid")
    dealt = dealt.select("token", "tile", "cid", "n", "pos", "guest", "label", "sig", "head")
    return dealt.mapInArrow(by_tile((one, out)), "a long, b long").distinct()


def exact_links(pairs: DataFrame, docs: DataFrame, rows: DataFrame, pct: int) -> DataFrame:
    """The (a, b) whose sets are alike, by intersecting their sorted arrays.

    The arrays are made from the texts again, of documents whose classes are in ``pairs`` only. ``a``'s
    array opens a (class, salt) and its partners stream past it.
    """
    needed = shared_checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
    few = F.broadcast if needed.count() <= MAX_BROADCAST_CLASSES else (lambda df: df)
    ids = (rows.where(F.col("sig").isNotNull()).join(few(needed), "cid", "left_semi")
           .dropDuplicates(["cid"]).select(F.col("doc_id").alias("_id")))  # one document of each class
    texts_of = docs.join(few(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def sets(batches):
        import pyarrow as pa
        words, seen = WordHasher(), set()
        for b in batches:
            cids, arrays = [], []
            for t in b.column(0).cast(pa.binary()).to_pylist():
                h = shingle_set(t, words)
                c = class_of(h) if len(h) else None
                if c is not None and c not in seen:
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(c)
                    cids.append(c)
                    arrays.append(h.tobytes())
            yield pa.RecordBatch.from_pydict({"cid": pa.array(cids, pa.int64()), "arr": pa.array(arrays, pa.binary())})
    arrays = texts_of.select("text").mapInArrow(sets, "cid long, arr binary")
    arrays = arrays.join(few(needed), "cid", "left_semi").dropDuplicates(["cid"])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        left = None
        for b in batches:
            a, c, arr = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            found = []
            for i in range(b.num_rows):
                h = np.frombuffer(arr[i].as_buffer(), dtype=np.uint64)
                if c[i] is None:
                    left = h.copy()
                else:
                    at = np.searchsorted(left, h).clip(max=len(left) - 1)
                    if alike(int((left[at] == h).sum()), len(left), len(h), pct):
                        found.append(i)
            yield b.select([0, 1]).take(pa.array(found, pa.int64()))
    # An opener goes to as many tasks as its partners need, so a pair costs little more than its partner's array.
    many = pairs.groupBy(F.col("a").alias("_a")).agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("_s"))
    salted = pairs.join(many, F.col("a") == F.col("_a")).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("_s"))).drop("_a", "_s")
    partners = salted.join(arrays, F.col("b") == F.col("cid")).select("a", "salt", "b", "arr")
    openers = (salted.select("a", "salt").distinct().join(arrays, F.col("a") == F.col("cid"))
               .select("a", "salt", F.lit(None).cast("long").alias("b"), "arr"))
    dealt = (partners.unionByName(openers).repartition("a", "salt")
             .sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()))
    return dealt.select("a", "b", "arr").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(cid, label) of every node of (a, b): the smallest node it is connected to.

    Alternates large-star and small-star steps until every node points to its
    component's smallest one; each step only moves edges, written to the shared checkpoint folder.
    """
    def pointed(sym, low):
        """Edges (u, v) of ``sym`` with the smallest node around u, as (v or u, smallest)."""
        m = sym.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        j = sym.join(m.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u"))
        if low:
            ends = F.explode(F.array("u", "v"))
            return j.select(ends.alias("u"), F.col("m").alias("v"))
        return j.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))

    def state(e):
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        return r["n"], r["h"]
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = shared_checkpoint(e)
    now = state(e)
    while now[0]:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = pointed(sym, False).where("u <> v").distinct()
        e = shared_checkpoint(pointed(large, True).where("u <> v").distinct())
        before, now = now, state(e)
        if before == now:
            break
    nodes = e.groupBy(F.col("u").alias("cid")).agg(F.min("v").alias("label"))
    return nodes.unionByName(e.select(F.col("v").alias("cid"), F.col("v").alias("label")).distinct())


def similar_classes(docs: DataFrame, pct: int = 80, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """((doc_id, cid, n), (cid, label)): each document's class, and the group of each class that has a link."""
    hot = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))
    rows = shared_checkpoint(class_rows(docs, pct, hot))
    head = F.substring("prefix", 1, 8 * HEAD).alias("head")
    sigs = rows.where(F.col("sig").isNotNull()).select("cid", "n", "sig", head).dropDuplicates(["cid"])
    tiles = shared_checkpoint(make_tiles(rows, pct, tile))
    stars = tiles.where(F.col("leader").isNotNull()).select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct()
    first = shared_checkpoint(bounded_pairs(stars, sigs, pct))
    groups = shared_checkpoint(components(exact_links(first, docs, rows, pct)))
    members = labelled(tiles.drop("leader"), groups, groups.count() <= MAX_BROADCAST_CLASSES)
    mixed = (members.groupBy(F.col("token").alias("_t"), F.col("tile").alias("_k"))
             .agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo <> _hi").select("_t", "_k"))
    members = members.join(mixed, (F.col("token") == F.col("_t")) & (F.col("tile") == F.col("_k"))).drop("_t", "_k")
    members = with_partners(members, pct)
    members = members.join(sigs.select(F.col("cid").alias("_c"), "sig", "head"), F.col("cid") == F.col("_c")).drop("_c")
    marked = shared_checkpoint(marked_members(members, pct).drop("label"))
    tried = shared_checkpoint(tile_pairs(marked, groups, pct, spanning=True))
    groups = shared_checkpoint(joined_groups(groups, exact_links(tried, docs, rows, pct)))
    others = tile_pairs(marked, groups, pct, spanning=False).join(tried, ["a", "b"], "left_anti")
    others = shared_checkpoint(others)
    return rows.select("doc_id", "cid", "n"), joined_groups(groups, exact_links(others, docs, rows, pct))


def labelled(members: DataFrame, groups: DataFrame, small: bool = False) -> DataFrame:
    """``members`` with the label of each class's group, its own id without one; ``small`` groups are broadcast."""
    g = groups.select(F.col("cid").alias("_c"), "label")
    g = F.broadcast(g) if small else g
    return members.join(g, F.col("cid") == F.col("_c"), "left").withColumn("label", F.coalesce("label", "cid")).drop("_c")


def joined_groups(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(cid, label) after more links."""
    return components(groups.select(F.col("cid").alias("a"), F.col("label").alias("b")).unionByName(links))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pct: int = 80,
                   tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, group_id), one row per row of ``docs``.

    Two rows link if the Jaccard similarity of their sets of 5-word shingles is ``pct`` per cent or
    more; ``component_id`` is the smallest id reachable by links, its own included. A NULL or empty text, or one
    without words, has the empty set and links with nothing. Repeated rows have one set and
    are linked, whatever their ids. A NULL id counts as no id: ``component_id`` is then the smallest id
    of the others, or NULL. An empty table gives no rows. ``class_id`` is the hash of the row's set and
    ``group_id`` the smallest of the group's, both NULL for an empty set.
    """
    rows, groups = similar_classes(texts(docs, id_col, text_col), pct, tile)
    placed = labelled(rows.where(F.col("cid").isNotNull()), groups)
    first = placed.groupBy(F.col("label").alias("_l")).agg(F.min("doc_id").alias("component_id"))
    out = placed.join(first, F.col("label") == F.col("_l")).select("doc_id", "n", "component_id", "cid", "label")
    empty = rows.where(F.col("cid").isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id"), "cid",
                                                     F.lit(None).cast("long").alias("label"))
    return out.unionByName(empty).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id",
                                         F.col("cid").alias("class_id"), F.col("label").alias("group_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pct: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: each group keeps its row with the smallest id.

    Of rows that repeat that id and set one stays. Rows with an empty set all stay.
    """
    groups = jaccard_groups(docs, id_col, text_col, pct)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class_id")).alias("b")
    stay = groups.where(F.col("group_id").isNotNull()).groupBy("group_id").agg(best).select(
        F.col("b.doc_id").alias("_id"), F.col("b.class_id").alias("_class"))

    def class_id():
        words = WordHasher()

        def one(text):
            h = shingle_set(text.encode("utf-8", "replace"), words)
            return class_of(h) if len(h) else None
        return one
    rows = map_rows(docs, class_id, "long", text_col).withColumn("_d", F.col("row").getField(id_col).cast("long"))
    found = rows.join(stay, (F.col("value") == F.col("_class")) & F.col("_d").eqNullSafe(F.col("_id")))
    again = Window.partitionBy("value", "_d").orderBy(F.xxhash64("row"))
    found = found.withColumn("_k", F.row_number().over(again)).where("_k = 1")
    return found.select("row.*").unionByName(rows.where(F.col("value").isNull()).select("row.*"))
