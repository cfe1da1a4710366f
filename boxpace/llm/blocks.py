"""Exact dedup by deterministic block naming (operator 9).

Every normalised text is cut into fixed-size blocks. The blocks of all documents are
sorted, and each distinct block gets its rank as an integer name. Adjacent names
are then paired, the pairs sorted and named in the same way, and so on: after
ceil(log2(blocks)) rounds a document is one name. Names stand for contents compared
in full, so two documents share a name on a level if and only if their texts are
equal; no hash decides.

A round names its values by one range-partitioned sort. Rows are placed by (hash of the
value, hash of the row), so a value that a third of the rows hold is spread over many
partitions; within a partition equal values are neighbours and get a local rank. The
partitions' first and last values (two rows each) tell where a value goes on in the next
partition, which turns local ranks into global ones.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_checkpoint, texts

BLOCK_BYTES = 2048
# The rows of one group of equal texts are dealt to so many parts by their hash.
GROUP_PARTS = 256
_BLANKS = b" \t\n\x0b\x0c\r"


def normalise(text: bytes) -> bytes:
    """Each run of blanks becomes one space, also at both ends."""
    body = b" ".join(text.split())
    if not text:
        return text
    if not body:
        return b" "
    return (b" " if text[0] in _BLANKS else b"") + body + (b" " if text[-1] in _BLANKS else b"")


def cut_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(doc_id, sha, pos, block) of each normalised text; an empty text is one empty block."""
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        for b in batches:
            blocks, pos, sha, n = [], [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                t = normalise(t)
                cuts = [t[i:i + block_bytes] for i in range(0, len(t), block_bytes)] or [b""]
                blocks += cuts
                pos += range(len(cuts))
                sha += [hashlib.sha256(t).digest()] * len(cuts)
                n.append(len(cuts))
            ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), n)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sha, pa.binary()), pa.array(pos, pa.int32()),
                                              pa.array(blocks, pa.binary())], names=["doc_id", "sha", "pos", "block"])
    return docs.mapInArrow(run, "doc_id long, sha binary, pos int, block binary")


def name_values(rows: DataFrame, value: list[str]) -> DataFrame:
    """Replace the ``value`` columns by ``name``: 0, 1, 2, ... for the distinct values in sorted order.

    The order is by hash, then by value. The other columns are kept.
    """
    keep = [c for c in rows.columns if c not in value]
    n_keep = len(keep)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        part, rank, last, held = TaskContext.get().partitionId(), -1, None, None

        def out(b, ranks, edges):
            cols = [b.column(k) for k in range(n_keep)]
            at = pa.array([i if i in edges else None for i in range(b.num_rows)], pa.int64())
            cols += [b.column(k).take(at) for k in range(n_keep, b.num_columns)]
            cols += [pa.array(np.full(b.num_rows, part), pa.int32()), pa.array(ranks),
                     pa.array([i in edges for i in range(b.num_rows)])]
            return pa.RecordBatch.from_arrays(cols, names=[*keep, *value, "_part", "_rank", "_edge"])
        for b in batches:
            if not b.num_rows:
                continue
            vals = [b.column(k) for k in range(n_keep, b.num_columns)]
            new = np.zeros(b.num_rows, dtype=bool)
            for v in vals:
                new[1:] |= pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False)
            first = [v[0].as_py() for v in vals]
            new[0] = first != last
            ranks = rank + np.cumsum(new)
            if held is not None:
                yield out(*held)
            held = (b, ranks, {0} if last is None else set())
            rank, last = int(ranks[-1]), [v[len(v) - 1].as_py() for v in vals]
        if held is not None:
            held[2].add(held[0].num_rows - 1)
            yield out(*held)
    place = F.xxhash64(*value)
    salt = F.xxhash64(*keep)
    spread = (rows.withColumns({"_h": place, "_s": salt}).repartitionByRange("_h", "_s")
              .sortWithinPartitions("_h", *value).drop("_h", "_s").select(*keep, *value))
    types = dict(rows.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in [*keep, *value]] + ["_part int", "_rank long", "_edge boolean"])
    ranked = shared_checkpoint(spread.mapInArrow(run, schema))
    # Two rows per partition, whatever the input's size.
    edges = ranked.where("_edge").select("_part", "_rank", *value).orderBy("_part", "_rank").collect()
    starts, end, prev = {}, -1, None
    for e in edges:
        v = tuple(e[c] for c in value)
        if e["_part"] not in starts:
            starts[e["_part"]] = (end if v == prev else end + 1) - e["_rank"]
        end, prev = starts[e["_part"]] + e["_rank"], v
    spark = rows.sparkSession
    offsets = spark.createDataFrame(list(starts.items()) or [(0, 0)], "_p int, _start long")
    return (ranked.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
            .select(*keep, (F.col("_rank") + F.col("_start")).alias("name")))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, sha, copies, level, name): one row per distinct (id, text); equal texts share (level, name).

    ``docs`` is (doc_id, text). ``copies`` counts rows with the same id and text.
    """
    named = name_values(cut_blocks(docs, block_bytes), ["block"])
    # One row per document with its names in order: a text of n bytes has n / block_bytes of them.
    seq = (named.groupBy("doc_id", "sha")
           .agg(F.sort_array(F.collect_set(F.struct("pos", "name"))).alias("_s"),
                F.count_if(F.col("pos") == 0).alias("copies"))
           .select("doc_id", "sha", "copies", F.col("_s.name").alias("_names")))
    seq = shared_checkpoint(seq)
    done, level = [], 0
    longest = seq.agg(F.max(F.size("_names"))).first()[0] or 0
    while True:
        one = seq.where(F.size("_names") == 1)
        done.append(one.select("doc_id", "sha", "copies", F.lit(level).alias("level"), F.col("_names")[0].alias("name")))
        if longest <= 1:
            break
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_names") - 1) / 2).cast("int")),
                            lambda i: F.struct(i.alias("pos"), F.col("_names")[2 * i].alias("left"),
                                               F.coalesce(F.get("_names", 2 * i + 1), F.lit(-1)).alias("right")))
        rows = (seq.where(F.size("_names") > 1).select("doc_id", "sha", "copies", F.explode(pairs).alias("_p"))
                .select("doc_id", "sha", "copies", "_p.*"))
        named = name_values(rows, ["left", "right"])
        seq = (named.groupBy("doc_id", "sha", "copies").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("_s"))
               .select("doc_id", "sha", "copies", F.col("_s.name").alias("_names")))
        seq = shared_checkpoint(seq)
        longest, level = -(-longest // 2), level + 1
    return reduce(lambda a, b: a.unionByName(b), done)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Texts are equal if identical after each run of blanks became one space. Of
    equal texts the row with the smallest id stays; of rows that repeat that id and text
    exactly one does. A NULL text is empty, a NULL id ranks after all others (``keep_id`` is NULL
    only where every row of the group lacks an id, and one of them stays). An empty table gives no rows.
    """
    ids = identities(texts(docs, id_col, text_col), block_bytes)
    # A group's figures go to the parts its rows were dealt to, so no task gets all rows of a large group.
    ids = ids.withColumn("part", F.pmod(F.xxhash64("doc_id", "sha"), F.lit(GROUP_PARTS)))
    parts = ids.groupBy(F.col("level").alias("_l"), F.col("name").alias("_n"), F.col("part").alias("_p")).agg(
        F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = parts.groupBy("_l", "_n").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"),
                                           F.collect_list("_p").alias("_parts"))
    groups = groups.select("_l", "_n", "keep_id", "group_size", F.explode("_parts").alias("_p"))
    rows = ids.join(groups, (F.col("level") == F.col("_l")) & (F.col("name") == F.col("_n")) & (F.col("part") == F.col("_p")))
    rows = rows.select("doc_id", "keep_id", "group_size", "sha",
                       F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    return rows.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                       (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
                       F.lower(F.hex("sha")).alias("text_sha256"))
