"""Centroid clustering over integer vectors by scalar lookup tables (operator 11).

Vectors become integers once and are written to the shared checkpoint folder in
blocks. A block holds up to ``BLOCK_ROWS`` vectors coded by dimension: the integers
that occur in the dimension, sorted, and for every vector the position of its
integer among them. In a round each block tabulates, for every dimension, the
squared difference of every occurring integer to every centroid; a vector's
distances are then the sum of one table row per dimension, gathered with NumPy.

What leaves a task in a round is one row of counts and sums per cluster, which
Spark adds up; the driver holds the centroids only (``k`` rows). All arithmetic is on
integers, so partitions, retries and block borders can't change the result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, shared_checkpoint

BLOCK_ROWS = 4096
# Integers beyond this count as this, so that every squared distance fits a long (64 * (2 * 2^27)^2 = 2^62).
MAX_VALUE = 1 << 27


def integer_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x): rows whose vector has ``dims`` finite components, as array<int> floor(scale * component)."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    ok = (F.size(F.col(vec_col)) == dims) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    bound = float(MAX_VALUE)
    ints = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), x * scale))).cast("int"))
    return (vectors.where(F.coalesce(ok, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("x")))


def code_blocks(rows: DataFrame, dims: int, block_rows: int) -> DataFrame:
    """(ids, has_id, values, starts, codes): blocks of vectors coded by the integers that occur per dimension."""
    bound_batches(rows.sparkSession)

    def code(ids, x):
        import numpy as np
        values, starts, codes = [], [0], np.empty((dims, len(ids)), dtype=np.int32)
        for d in range(dims):
            u, codes[d] = np.unique(x[:, d], return_inverse=True)
            values.append(u)
            starts.append(starts[-1] + len(u))
        known = np.array([i is not None for i in ids])
        number = np.array([i or 0 for i in ids], dtype=np.int64)
        return (number.tobytes(), known.tobytes(), np.concatenate(values).astype(np.int32).tobytes(),
                np.array(starts, dtype=np.int32).tobytes(), codes.tobytes())

    def run(batches):
        import numpy as np
        import pyarrow as pa
        names = ["ids", "has_id", "values", "starts", "codes"]
        ids, parts, n = [], [], 0

        def block():
            cells = code(ids, np.concatenate(parts))
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=names)
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            every = b.column(0).to_pylist()
            at = 0
            while at < len(every):
                take = min(block_rows - n, len(every) - at)
                ids += every[at:at + take]
                parts.append(x[at:at + take])
                n, at = n + take, at + take
                if n == block_rows:
                    yield block()
                    ids, parts, n = [], [], 0
        if n:
            yield block()
    return rows.mapInArrow(run, "ids binary, has_id binary, values binary, starts binary, codes binary")


def table_distances(values, starts, codes, centroids):
    """Squared distances (vectors x centroids): one table per dimension, gathered by code and summed."""
    import numpy as np
    out = np.zeros((codes.shape[1], len(centroids)), dtype=np.int64)
    for d in range(len(codes)):
        occurring = values[starts[d]:starts[d + 1]].astype(np.int64)
        table = (occurring[:, None] - centroids[None, :, d]) ** 2
        out += table[codes[d]]
    return out


def _unpack(batch, dims: int):
    """(ids, has_id, values, starts, codes) of each block of an Arrow batch as arrays."""
    import numpy as np
    for r in batch.to_pylist():
        yield (np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["has_id"], dtype=bool),
               np.frombuffer(r["values"], dtype=np.int32), np.frombuffer(r["starts"], dtype=np.int32),
               np.frombuffer(r["codes"], dtype=np.int32).reshape(dims, -1))


def _move(blocks: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """The centroids after one round: exact floors of the means; an empty cluster keeps its centroid."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        c = np.array(centroids, dtype=np.int64)
        count, sums = np.zeros(len(c), dtype=np.int64), np.zeros((len(c), dims), dtype=np.int64)
        for b in batches:
            for _, _, values, starts, codes in _unpack(b, dims):
                nearest = table_distances(values, starts, codes, c).argmin(axis=1)
                count += np.bincount(nearest, minlength=len(c))
                x = values[codes + starts[:-1, None]].astype(np.int64)
                for k in np.unique(nearest):
                    sums[k] += x[:, nearest == k].sum(axis=1)
        has = np.flatnonzero(count)
        cells = np.concatenate([count[has, None], sums[has]], axis=1)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(np.repeat(has, dims + 1), pa.int32()),
            "cell": pa.array(np.tile(np.arange(dims + 1), len(has)), pa.int32()), "s": pa.array(cells.ravel(), pa.int64())})
    part = blocks.mapInArrow(run, "cluster int, cell int, s long")
    # k * (dims + 1) rows come to the driver: the vectors and component sums of each cluster.
    whole = {(r["cluster"], r["cell"]): int(r["s"])
             for r in part.groupBy("cluster", "cell").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return [[whole[k, d + 1] // whole[k, 0] for d in range(dims)] if (k, 0) in whole else list(c)
            for k, c in enumerate(centroids)]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3,
            id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of every usable vector.

    A vector is usable if it has exactly ``dims`` components, none of them NULL, NaN or
    infinite; other rows, and NULL vectors, are left out. A component x counts as the integer floor(scale * x)
    of x as double, limited to +-2^27. The first centroids are the ``k`` vectors with the smallest
    sha256 of ``<seed>:<vec_id>``, equal ids by their components, rows without id last; fewer vectors
    give fewer centroids. Every round moves each centroid that has vectors to the floor of their
    mean, component by component; a last assignment follows. Ties go to the smaller number.
    ``distance`` is the squared distance to the final centroid, ``centroid`` its components.
    Repeated rows count each; a NULL vec_id stays NULL; an empty table gives no rows; other columns are not read.
    """
    rows = integer_vectors(vectors, dims, scale, id_col, vec_col)
    blocks = shared_checkpoint(code_blocks(rows, dims, block_rows))
    key: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(key.asc_nulls_last(), "x").limit(k).collect()  # k rows
    centroids = [list(r["x"]) for r in first]
    for _ in range(rounds if centroids else 0):
        centroids = _move(blocks, centroids, dims)

    def assign(batches):
        import numpy as np
        import pyarrow as pa
        c = np.array(centroids, dtype=np.int64)
        for b in batches:
            for ids, has_id, values, starts, codes in _unpack(b, dims):
                dist = table_distances(values, starts, codes, c)
                near = dist.argmin(axis=1)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": pa.array(ids, pa.int64(), mask=~has_id), "cluster": pa.array(near, pa.int32()),
                    "distance": pa.array(dist[np.arange(len(near)), near], pa.int64())})
    out = blocks.mapInArrow(assign, "vec_id long, cluster int, distance long")
    totals = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_s"))
    totals = totals.select(F.col("cluster").alias("_c"), F.col("_s").cast("long").alias("cluster_inertia"),
                           F.sum("_s").over(Window.partitionBy(F.lit(0))).cast("long").alias("inertia"))
    finals = F.array(*[F.array(*[F.lit(int(x)) for x in c]) for c in centroids]) if centroids else F.lit(None).cast(
        "array<array<int>>")
    # At most k rows on the broadcast side.
    return (out.join(F.broadcast(totals), F.col("cluster") == F.col("_c")).drop("_c")
            .withColumn("centroid", F.get(finals, F.col("cluster"))))
