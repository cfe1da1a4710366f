"""Line dedup over a sharded minimal perfect hash (operator 6).

1. One pass over the texts emits a 128-bit hash for each distinct line key of a
   document; the slim rows are written to the shared checkpoint folder.
2. The hashes are counted with map-side combining (documents, largest id).
3. Keys in ``min_docs`` documents or more are split into shards of about
   ``SHARD_KEYS``. Each shard gets a minimal perfect hash: a function that sends its
   keys to 0..n-1 without collision, and at those places an array of 64-bit
   fingerprints, one of counts and one of largest ids. No key is stored.
4. Documents probe the arrays: their slim rows are dealt to (shard, salt) and
   stream past the shard's arrays. Salts spread a line that a third of the documents
   hold. Only lines to be dropped come back, by document.
5. The texts drop those lines.

A key outside the index meets a foreign fingerprint; with 64 bits on top of
the 128-bit hash, a wrong match has a chance of 2^-64 per probe.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, shared_checkpoint, texts

SHARD_KEYS = 1 << 16
# Probes of a shard for each of its salts, beyond the salts that every shard has.
SALT_PROBES = 1 << 20
# Slots per key left on a level of the perfect hash; more slots, fewer levels.
GAMMA = 2.0
_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The line stripped of blanks at both ends, A-Z lower-cased (``bytes.lower`` changes nothing else)."""
    return line.strip(_STRIP).lower()


def code_points(b: bytes) -> int:
    return len(b) if b.isascii() else len(b.decode("utf-8", errors="replace"))


def key_hash(key: bytes) -> bytes:
    import xxhash
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h1, h2): hashes of the distinct keys of at least ``min_chars`` code points of each row."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            digests, n = [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                found = set()
                for line in t.split(b"\n"):
                    if len(line) >= min_chars:
                        k = line_key(line)
                        if len(k) >= min_chars and code_points(k) >= min_chars:
                            found.add(key_hash(k))
                digests.extend(sorted(found))
                n.append(len(found))
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), n)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))],
                names=["doc_id", "h1", "h2"])
    return docs.mapInArrow(run, "doc_id long, h1 long, h2 long")


def _mix(h1, h2, level: int):
    """A 64-bit hash of two uint64 arrays for one level."""
    import numpy as np
    with np.errstate(over="ignore"):
        x = (h1 + np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2 ** 64 - 1))) ^ h2
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct (h1, h2) pairs: levels of bits, ranks give the slots.

    On each level every remaining key sets one of GAMMA times as many bits; keys
    alone on their bit are settled there, the others go to the next level.
    """

    def __init__(self, levels):
        import numpy as np
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            r = np.cumsum(bits, dtype=np.int64) - bits + base
            self.ranks.append(r)
            base += int(bits.sum())
        self.n = base

    @classmethod
    def build(cls, h1, h2):
        import numpy as np
        levels, left = [], np.arange(len(h1))
        while len(left):
            if len(levels) == 256:
                raise ValueError("keys are not distinct")
            size = max(1, int(GAMMA * len(left)))
            at = _mix(h1[left], h2[left], len(levels)) % np.uint64(size)
            bits = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(bits)
            left = left[~bits[at.astype(np.int64)]]
        return cls(levels)

    def slots(self, h1, h2):
        """Slot of each key, -1 for some of the keys that were not built in."""
        import numpy as np
        out, left = np.full(len(h1), -1, dtype=np.int64), np.arange(len(h1))
        for k, bits in enumerate(self.levels):
            if not len(left):
                break
            at = (_mix(h1[left], h2[left], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.ranks[k][at[hit]]
            left = left[~hit]
        return out


def pack_shard(h1, h2, count, last) -> bytes:
    """One shard as bytes: bit levels, and arrays of fingerprint, count and largest id by slot.

    ``last`` may be masked: a key held by rows without an id only.
    """
    import io

    import numpy as np
    ph = PerfectHash.build(h1, h2)
    slot = ph.slots(h1, h2)
    order = np.argsort(slot)
    buf = io.BytesIO()
    np.savez(buf, sizes=np.array([len(x) for x in ph.levels], dtype=np.int64),
             bits=np.packbits(np.concatenate(ph.levels)), fp=h2[order],
             count=np.minimum(count[order], 2 ** 32 - 1).astype(np.uint32), last=last.filled(0)[order],
             has=~np.ma.getmaskarray(last)[order])
    return buf.getvalue()


class Shard:
    def __init__(self, blob: bytes):
        import io

        import numpy as np
        z = np.load(io.BytesIO(blob))
        sizes = z["sizes"]
        bits = np.unpackbits(z["bits"], count=int(sizes.sum())).astype(bool)
        self.hash = PerfectHash(np.split(bits, np.cumsum(sizes)[:-1]))
        self.fp, self.count, self.last, self.has = z["fp"], z["count"], z["last"], z["has"]

    def probe(self, h1, h2):
        """(slot, known) of each key."""
        slot = self.hash.slots(h1, h2)
        safe = slot.clip(0)
        return safe, (slot >= 0) & (self.fp[safe] == h2)


def build_index(counts: DataFrame, n_shards: int) -> DataFrame:
    """(shard, blob) from (h1, h2, n_docs, last_doc): one perfect hash with its arrays per shard."""
    def build(t):
        import numpy as np
        import pyarrow as pa
        u = [t.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2")]
        last = t.column("last_doc")
        masked = np.ma.masked_array(last.fill_null(0).to_numpy(), mask=last.is_null().to_numpy())
        blob = pack_shard(*u, t.column("n_docs").to_numpy(), masked)
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int64()), "blob": pa.array([blob], pa.binary())})
    keyed = counts.withColumn("shard", F.pmod(F.col("h1"), F.lit(n_shards)))
    return keyed.groupBy("shard").applyInArrow(build, "shard long, blob binary")


def hot_shards(counts: DataFrame, n_shards: int, salts: int, salt_probes: int) -> DataFrame:
    """(shard, salts) of the shards whose keys are held so often that they need more than ``salts`` salts.

    One of ``salt_probes`` held lines or more each, so there are few.
    """
    n = F.ceil(F.sum("n_docs") / F.lit(salt_probes)).cast("long")
    return (counts.groupBy(F.pmod(F.col("h1"), F.lit(n_shards)).alias("_hot")).agg(n.alias("_salts"))
            .where(F.col("_salts") > salts))


def probe_index(lines: DataFrame, index: DataFrame, counts: DataFrame, n_shards: int, min_docs: int) -> DataFrame:
    """(doc_id, h1) of the lines that ``doc_id`` has to drop.

    Each shard is copied to its salts, and its probes are dealt to them: enough to use all shuffle
    partitions, and for shards with hot lines one for every SALT_PROBES lines held.
    """
    spark = lines.sparkSession
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_shards))
    hot = hot_shards(counts, n_shards, salts, SALT_PROBES)

    def salted(df):
        return (df.join(F.broadcast(hot), F.col("shard") == F.col("_hot"), "left")
                .withColumn("_salts", F.coalesce("_salts", F.lit(salts).cast("long"))))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        shard = None
        for b in batches:
            blobs = b.column(0)
            h1, h2 = (b.column(k).fill_null(0).to_numpy().view(np.uint64) for k in (2, 3))
            # An index row opens its (shard, salt); the probes that follow are that shard's.
            opens = np.flatnonzero(blobs.is_valid().to_numpy(zero_copy_only=False))
            ends = [*opens, b.num_rows]
            for k, (start, end) in enumerate(zip([0, *(opens + 1)], ends)):
                if k:
                    shard = Shard(blobs[int(opens[k - 1])].as_py())
                if end > start:
                    slot, known = shard.probe(h1[start:end], h2[start:end])
                    ids = b.column(1).slice(start, end - start)
                    mine = ids.fill_null(0).to_numpy() == shard.last[slot]
                    mine = np.where(ids.is_valid().to_numpy(zero_copy_only=False), mine, True) & (
                        ids.is_valid().to_numpy(zero_copy_only=False) == shard.has[slot])
                    drop = pa.array(known & (shard.count[slot] >= min_docs) & ~mine)
                    yield pa.RecordBatch.from_arrays([ids.filter(drop), b.column(2).slice(start, end - start).filter(drop)],
                                                     names=["doc_id", "h1"])
    probes = salted(lines.select("doc_id", "h1", "h2", F.pmod("h1", F.lit(n_shards)).alias("shard"))).select(
        F.lit(None).cast("binary").alias("blob"), "doc_id", "h1", "h2", "shard",
        F.pmod(F.xxhash64("doc_id", "h2"), F.col("_salts")).alias("salt"))
    nothing = F.lit(None).cast("long")
    arrays = salted(index).select("blob", nothing.alias("doc_id"), nothing.alias("h1"), nothing.alias("h2"), "shard",
                                  F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("salt"))
    dealt = (arrays.unionByName(probes).repartition("shard", "salt")
             .sortWithinPartitions("shard", "salt", F.col("blob").isNull()))
    return dealt.select("blob", "doc_id", "h1", "h2").mapInArrow(run, "doc_id long, h1 long")


def cut_lines(text: bytes, drop: set, min_chars: int) -> tuple[int, int, bytes]:
    """(lines, dropped lines, text left) without the lines whose key's first hash is in ``drop``."""
    import numpy as np
    lines, rest = text.split(b"\n"), []
    for line in lines:
        k = line_key(line)
        if (len(k) < min_chars or code_points(k) < min_chars
                or int(np.frombuffer(key_hash(k), dtype="<i8")[0]) not in drop):
            rest.append(line)
    return len(lines), len(lines) - len(rest), b"\n".join(rest)


def drop_lines(docs: DataFrame, drops: DataFrame, min_chars: int) -> DataFrame:
    """Add (n_lines, n_dropped, kept_text) to ``docs`` (doc_id, text, ...), given the (doc_id, h1) to drop."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    per_doc = drops.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("h1").alias("_drop"))
    n_cols = len(docs.columns)
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType()),
                         StructField("kept_text", StringType())])

    def run(batches):
        import pyarrow as pa
        for b in batches:
            out = [cut_lines(t, set(drop), min_chars) if drop else (t.count(b"\n") + 1, 0, t)
                   for t, drop in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(n_cols).to_pylist())]
            n, gone, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:n_cols], pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=schema.names)
    joined = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(*docs.columns, "_drop")
    return joined.mapInArrow(run, schema)


def line_drops(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, h1) of the lines each document of (doc_id, text) has to drop."""
    lines = shared_checkpoint(line_hashes(docs, min_chars))
    counts = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
    counts = shared_checkpoint(counts.where(F.col("n_docs") >= min_docs))
    n_keys = counts.count()
    if not n_keys:
        return counts.select(F.col("last_doc").alias("doc_id"), "h1")
    n_shards = -(-n_keys // SHARD_KEYS)
    return probe_index(lines, build_index(counts, n_shards), counts, n_shards, min_docs)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                min_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text), one row per row of ``docs``.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of
    ``min_chars`` code points or more that ``min_docs`` documents or more hold lose all their
    lines except in the document with the largest id. A NULL or empty text is one empty line.
    Every row counts as a document, also one with a repeated id. A NULL id
    is below every other; rows that share the largest id, or that all lack one, all keep
    their lines. Other lines stay in order. An empty table gives no rows.
    """
    d = texts(docs, id_col, text_col)
    return drop_lines(d, line_drops(d, min_chars, min_docs), min_chars).drop("text")


def rewrite_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars",
                  min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, with the text that :func:`dedup_lines` leaves.

    ``length_col``, if there is one, gets the new text's length. A text that loses no line stays as it
    is, NULL included; rows stay even if nothing is left of their text.
    """
    bound_batches(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                    F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
                    F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    drops = line_drops(d.select("doc_id", "text"), min_chars, min_docs)
    out, types = drop_lines(d, drops, min_chars), dict(docs.dtypes)
    lost = F.col("n_dropped") > 0
    new = {text_col: F.col("kept_text")}
    if length_col in docs.columns:
        new[length_col] = F.length("kept_text").cast(types[length_col])
    return out.select(*[F.when(lost, new[c]).otherwise(F.col("row").getField(c)).alias(c) if c in new
                        else F.col("row").getField(c).alias(c) for c in docs.columns])
