"""Lloyd's clustering with the dimensions dealt over tasks.

Vectors are cut into groups of rows and blocks of columns; one shard holds one
column block of some row groups, and is dealt once from the shared checkpoint
folder.  Every round

1. each shard takes the slices of the centroids that belong to its columns and gives its
   part of every squared distance, exactly;
2. ``reduceByKey`` adds the parts of a row group over the column blocks, and the
   smallest sum names each row's cluster;
3. the clusters go back to the shards (which do not move: both sides are dealt by
   one rule), and each column block adds up its columns per cluster and moves its
   own slice of the centroids.

Only the centroids' slices, k numbers a column, come together on the driver.  A part
of a distance is kept in the least integer type that holds it: 32 bits, 64, or
Python's integers, so the arithmetic never overflows or rounds.
"""

from __future__ import annotations

import hashlib
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import checkpointed, release

#: Column blocks, and rows of one group (a shard holds SHARD_GROUPS groups).
BLOCKS, GROUP_ROWS, SHARD_GROUPS = 2, 8192, 8
SCALE = 1024
_LONG = 1 << 63


def usable(vector: Column, dims: int) -> Column:
    """Exactly ``dims`` components, none null, NaN or infinite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & ok, F.lit(False))


def fixed_point(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of float64 values, in the least integer type that holds them all."""
    if values.size and np.abs(values).max() >= 2.0 ** 52:
        whole = [int(v) * SCALE if abs(v) >= 2.0 ** 53 else math.floor(v * SCALE) for v in values.ravel().tolist()]
        return _least(np.array(whole, dtype=object).reshape(values.shape))
    return _least(np.floor(values * SCALE).astype(np.int64))


def _largest(values: np.ndarray) -> int:
    return max(int(values.max()), -int(values.min())) if values.size else 0


def _least(values: np.ndarray) -> np.ndarray:
    top = _largest(values)
    for kind in (np.int16, np.int32, np.int64):
        if top <= np.iinfo(kind).max:
            return values.astype(kind)
    return values.astype(object)


def partial_distances(rows: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """Exact sums of (x - c)**2 over the columns given: one row per vector, one column per centroid."""
    top = max(_largest(rows), _largest(slices))
    bound = 4 * top * top * max(rows.shape[1], 1)
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < _LONG else object
    x, c = rows.astype(kind), slices.astype(kind)
    found = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    return _least(found.astype(np.int64) if kind is np.float64 else found)


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    wide = object if object in (a.dtype, b.dtype) or _largest(a) + _largest(b) >= _LONG else np.int64
    return _least(a.astype(wide) + b.astype(wide))


def _nearest(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first least column of each row, and its value."""
    best = np.argmin(sums, axis=1)
    return best, sums[np.arange(len(sums)), best]


def slice_sums(rows: np.ndarray, clusters: np.ndarray, k: int) -> tuple[list[int], list[list[int]]]:
    """Rows and exact column sums of each cluster, as Python integers."""
    counts = np.bincount(clusters, minlength=k).tolist()
    wide = np.int64 if _largest(rows) * max(len(rows), 1) < _LONG else object
    order = np.argsort(clusters, kind="stable")
    ends = np.cumsum(counts)
    sums = [rows[order[end - n:end]].astype(wide).sum(axis=0).tolist() if n else [0] * rows.shape[1] for n, end in zip(counts, ends)]
    return counts, sums


def _sums_of(both: list, k: int):
    """``slice_sums`` of a shard's rows (bytes) and their clusters, in whichever order they come."""
    data, clusters = both if isinstance(both[0], bytes) else both[::-1]
    return slice_sums(pickle.loads(data), clusters, k)


def _add_sums(a, b):
    return ([x + y for x, y in zip(a[0], b[0])], [[x + y for x, y in zip(p, q)] for p, q in zip(a[1], b[1])])


def first_centroids(rows: DataFrame, k: int) -> list[list[int]]:
    """The k vectors of least sha-256 of ``3:<vec_id>`` (null ids last, repeated ids by their components)."""
    first = (rows.select("vec_id", "vector", F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"))
             .orderBy(F.col("h").asc_nulls_last(), "vector").limit(k).collect())
    return [fixed_point(np.array(r.vector, dtype=np.float64)).tolist() for r in first]


def _groups(rows: DataFrame, dims: int, blocks: int) -> DataFrame:
    """Row groups cut by column block: key, block (-1: the ids), n, kind, data."""
    edges = np.linspace(0, dims, blocks + 1).astype(int).tolist()

    def cut(batches):
        part, number = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []

        def flush(found):
            nonlocal number
            ids = found.column("vec_id").to_pylist()
            values = np.array(found.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
            whole = values.reshape(len(ids), dims)
            out = [(-1, pickle.dumps(np.array(ids, dtype=object if None in ids else np.int64)))]
            out += [(b, pickle.dumps(np.ascontiguousarray(fixed_point(whole[:, edges[b]:edges[b + 1]])))) for b in range(blocks)]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([part + number - 1] * len(out), pa.int64()), pa.array([o[0] for o in out], pa.int32()),
                                               pa.array([o[1] for o in out], pa.binary())], ["key", "block", "data"])

        def drain(most):
            nonlocal held
            whole = pa.Table.from_batches(held)
            at = 0
            while whole.num_rows - at >= most:
                yield flush(whole.slice(at, GROUP_ROWS))
                at += GROUP_ROWS
            held = whole.slice(at).to_batches() if at < whole.num_rows else []

        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= GROUP_ROWS:
                yield from drain(GROUP_ROWS)
        if held:
            yield from drain(1)
        release()

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(
        cut, "key long, block int, data binary")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64,
            blocks: int = BLOCKS) -> tuple[DataFrame, list[list[int]]]:
    """Clusters of all usable vectors: rows (vec_id, cluster, distance), and the final centroids.

    Vectors with another number of components, or with null, NaN or infinite ones, are left
    out.  Components become floor(1024 * x).  Ties go to the smaller cluster number; an empty cluster's
    centroid stays.  Rows that repeat an id are vectors of their own; null ids are kept.  With
    fewer than k vectors there are that many clusters; with none the result is empty.  A distance
    over 2**63 - 1 is null.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where(usable(F.col("vector"), dims))
    centroids = first_centroids(rows, k)
    shape = "vec_id long, cluster int, distance long"
    if not centroids:
        return spark.createDataFrame([], shape), []
    k = len(centroids)
    edges = np.linspace(0, dims, blocks + 1).astype(int).tolist()
    cut = checkpointed(_groups(rows, dims, blocks))
    deals = max(1, -(-cut.where("block < 0").count() // SHARD_GROUPS))
    n = blocks * deals

    def place(key) -> int:  # a shard holds one column block of some row groups
        group, block = key
        return block * deals + ((group >> 32) * 31 + (group & 0xFFFFFFFF)) % deals

    pairs = cut.rdd.map(lambda r: (r.key, r.block, bytes(r.data)))
    # read from the checkpoint and dealt once; a lost executor's shards are dealt again from there
    shards = pairs.filter(lambda r: r[1] >= 0).map(lambda r: ((r[0], r[1]), r[2])).partitionBy(n, place)

    def distances(slices):
        return shards.map(lambda s: (s[0][0], partial_distances(pickle.loads(s[1]), slices[s[0][1]]))).reduceByKey(_add, deals).mapValues(_nearest)

    for _ in range(rounds):
        slices = [_least(np.array([c[a:z] for c in centroids], dtype=object)) for a, z in zip(edges, edges[1:])]
        named = distances(slices).flatMap(lambda s: [((s[0], b), s[1][0].astype(np.uint16 if k <= 1 << 16 else np.int64)) for b in range(blocks)])
        moved = (shards.union(named.partitionBy(n, place)).groupByKey(n, place)
                 .map(lambda s: (s[0][1], _sums_of(list(s[1]), k)))
                 .reduceByKey(_add_sums, blocks)
                 .mapValues(lambda found: [[x // c for x in sums] if c else None for c, sums in zip(*found)])
                 .collectAsMap())  # k numbers a column
        centroids = [[x for b, (a, z) in enumerate(zip(edges, edges[1:])) for x in (moved[b][j] if moved[b][j] is not None else centroids[j][a:z])]
                     for j in range(k)]
    slices = [_least(np.array([c[a:z] for c in centroids], dtype=object)) for a, z in zip(edges, edges[1:])]
    ids = pairs.filter(lambda r: r[1] < 0).map(lambda r: (r[0], r[2]))
    final = ids.join(distances(slices), deals).map(lambda s: (pickle.loads(s[1][0]), *s[1][1]))

    def each(s):
        return [(i, int(c), d if d < _LONG else None) for i, c, d in zip(s[0].tolist(), s[1].tolist(), s[2].tolist())]

    found = checkpointed(spark.createDataFrame(final.flatMap(each), shape))
    return found, centroids


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``cluster``'s rows with cluster_inertia, inertia and centroid_sha256.

    Distances are summed per cluster and over all, exactly; a sum over 2**63 - 1, or
    of a null distance, is null.  k rows meet the others, so the join is a broadcast.
    """
    sums = found.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s"))
    per = {r["cluster"]: r["s"] for r in sums.collect()}  # k rows
    total = None if None in per.values() else sum(per.values())

    def long(x):
        return None if x is None or x >= _LONG else int(x)

    rows = [(c, long(s), long(total), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in per.items()]
    named = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
