"""Vector retrieval V3-V7.

Distances are squared L2 by default (``cosine`` and ``dot`` are options),
computed in double from the stored floats and rounded to 6 places before
ranking; ties go to the smaller id.  No operator materialises query x index
pairs as rows: exact search meets bounded query blocks with bounded index
blocks in cogroup tasks that keep a running top-k per query (NumPy), then
merges ``k`` candidates per index block and query.
"""

from __future__ import annotations

from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, FloatType, LongType, StructField, StructType

from storelens.functions.windows import top_k_per_group


DEFAULT_K = 3  # fixed value from the reference search (k=3)
ROUND = 6
# Bytes of vectors on each side of one block pair (a block of queries against
# a block of index rows).  Both blocks of a pair sit in one task, so task
# memory is bounded by twice this, twice that again as doubles, plus one distance tile of
# TILE_QUERIES x TILE_ROWS doubles (8 MiB), whatever the table sizes.
BLOCK_BYTES = 16 << 20
TILE_QUERIES = 256
TILE_ROWS = 4096
# Rows of buckets are compared in tiles of at most so many pairs.
QUERY_STEP = 256
INDEX_STEP = 2048
# Queries are held against buckets in parts of so many pairs, and against buckets that may hold rows or not in parts of so many.
LOOK_CELLS = 1 << 23
PROBE_CELLS = 1 << 20
# Index rows, as doubles, that tell a query beforehand how near its neighbours must be, and how many of them it looks at for each neighbour.
SEED_BYTES = 1 << 20
SEED_NEAR = 8
# Query vectors, as doubles, that may travel to every index partition.
FEW_BYTES = 8 << 20
# Pairs whose exact distance is worked out at once (two copies of 64 dims: 64 MiB).
PAIR_STEP = 1 << 16
# Rows left of a tile are few if they are less than one in so many.
FEW = 16
# Below this many rows per block a table is not cut further just to use more cores.
MIN_BLOCK_ROWS = 256
CONTEXT_SEPARATOR = "\n\n...\n\n"  # fixed value: appended after every hit


# ------------------------------------------------------------------ V3

def attach_vectors(items: DataFrame, vectors: DataFrame, item_key: str, vector_key: str) -> DataFrame:
    """V3: items with their vector (inner join on the key)."""
    return items.join(vectors, F.col(item_key) == F.col(vector_key))


def missing_vectors(items: DataFrame, vectors: DataFrame, item_key: str, vector_key: str) -> DataFrame:
    """V3: items that have no vector (anti join)."""
    return items.join(vectors.select(F.col(vector_key).alias("__vk")),
                      F.col(item_key) == F.col("__vk"), "left_anti")


# ------------------------------------------------------------------ V4

def distance_expr(a: Column, b: Column, metric: str = "l2") -> Column:
    """Distance of two array columns as a Spark expression (double)."""
    ad = F.transform(a, lambda x: x.cast("double"))
    bd = F.transform(b, lambda x: x.cast("double"))
    if metric == "l2":
        terms = F.zip_with(ad, bd, lambda x, y: (x - y) * (x - y))
        return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    dot = F.aggregate(F.zip_with(ad, bd, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    if metric == "dot":
        return -dot
    if metric == "cosine":
        na = F.sqrt(F.aggregate(F.transform(ad, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))
        nb = F.sqrt(F.aggregate(F.transform(bd, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))
        # a zero vector has no direction: it is as far as an orthogonal one
        return F.when(na * nb > 0, F.lit(1.0) - dot / F.when(na * nb > 0, na * nb)).otherwise(F.lit(1.0))
    raise ValueError(metric)


def nearest(index: DataFrame, vector, k: int = DEFAULT_K, id_col: str = "vec_id",
            vec_col: str = "embedding", metric: str = "l2") -> DataFrame:
    """V4: the k nearest rows to one query vector (TakeOrderedAndProject)."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    d = F.round(distance_expr(F.col(vec_col), q, metric), ROUND)
    return (index.where(F.col(vec_col).isNotNull())
            .select(id_col, d.alias("dist"))
            .orderBy("dist", id_col).limit(k)
            .withColumn("rank", F.row_number().over(Window.orderBy("dist", id_col))))


# ------------------------------------------------------------------ V5

def _matrix(column) -> np.ndarray:
    """A column of vectors of one width as rows of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    widths = np.unique(pc.list_value_length(flat).to_numpy(zero_copy_only=False))
    if len(widths) > 1:
        raise ValueError(f"vectors of several widths: {widths.tolist()}")
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _sides(qm: np.ndarray, xm: np.ndarray, metric: str, dtype=np.float64):
    """Two matrices and a number per query whose product and sum bound the exact distance from below, and
    the numbers per query and row that, added, bound it from above.

    Rounding grows with the squared norms (for cosine they are 1) and the number of dimensions.
    """
    eps = 8 * (qm.shape[1] + 4) * np.finfo(dtype).eps
    q, x = (qm * qm).sum(1), (xm * xm).sum(1)
    if metric == "cosine":  # a zero vector stays one: it is as far as an orthogonal one
        qm, xm = (m / np.sqrt(np.where(n > 0, n, 1))[:, None] for m, n in ((qm, q), (xm, x)))
        q, x = np.ones(len(q)), np.ones(len(x))
    base, slope = {"l2": (1.0, -2.0), "dot": (0.0, -1.0), "cosine": (0.5, -1.0)}[metric]
    left = np.concatenate([slope * qm, np.ones((len(qm), 1))], axis=1)
    right = np.concatenate([xm, ((base - eps) * x)[:, None]], axis=1)
    return left.astype(dtype, copy=False), np.ascontiguousarray(right.T, dtype=dtype), (base - eps) * q, 2 * eps * q, 2 * eps * x


def _upward(m: np.ndarray, dtype) -> np.ndarray:
    """Numbers of ``dtype`` that are no less than those given."""
    return np.nextafter(m.astype(dtype), np.array(np.inf, dtype=dtype))


def _bounds(qm: np.ndarray, xm: np.ndarray, metric: str) -> list:
    """Functions for ``_sides`` in single precision, if it holds the vectors, and in double, for where the wider
    error of the former rules out too few rows.  Each works once, when it is first called."""
    norms = max((m * m).sum(1).max(initial=0.0) for m in (qm, xm))
    return [cache(partial(_sides, qm, xm, metric, dtype)) for dtype in ([np.float32] if norms < 1e30 else []) + [np.float64]]


def _exact(qm: np.ndarray, xm: np.ndarray, metric: str) -> np.ndarray:
    """Row-wise distance of paired rows, summed in index order like SQL does."""
    if metric == "l2":
        diff = qm - xm
        terms = diff * diff
    else:
        terms = qm * xm
    acc = np.zeros(len(terms))
    for j in range(terms.shape[1]):
        acc = acc + terms[:, j]
    if metric == "l2":
        return acc
    if metric == "dot":
        return -acc
    norms = np.linalg.norm(qm, axis=1) * np.linalg.norm(xm, axis=1)
    return 1.0 - np.divide(acc, norms, out=np.zeros_like(acc), where=norms > 0)


def _topk_rows(qi: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int):
    """Keep the k best (d, id) per query index."""
    order = np.lexsort((ids, d, qi))
    qi, ids, d = qi[order], ids[order], d[order]
    start = np.r_[0, np.flatnonzero(np.diff(qi)) + 1]
    rank = np.arange(len(qi)) - np.repeat(start, np.diff(np.r_[start, len(qi)]))
    keep = rank < k
    return qi[keep], ids[keep], d[keep]


def _distinct(qi: np.ndarray, ids: np.ndarray, d: np.ndarray):
    """One row per query and id, the nearest."""
    order = np.lexsort((d, ids, qi))
    qi, ids, d = qi[order], ids[order], d[order]
    first = np.append(True, (qi[1:] != qi[:-1]) | (ids[1:] != ids[:-1]))[:len(qi)]
    return qi[first], ids[first], d[first]


def _pair_topk(qids: np.ndarray, qm: np.ndarray, xid: np.ndarray, xm: np.ndarray, k: int, metric: str):
    """Exact top-k of every query in ``qm`` over the rows of ``xm``, walked in tiles.

    A tile of queries goes over all rows with its k best so far; what the k-th of them rules
    out by a bound from below is not looked at closer."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64))]
    bounds, space = _bounds(qm, xm, metric), np.empty(TILE_QUERIES * TILE_ROWS)
    for lo in range(0, len(qm), TILE_QUERIES):
        qs = qm[lo:lo + TILE_QUERIES]
        kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64))
        limit = np.full(len(qs), np.inf)  # the k-th distance is at most this; rounding moves either side by half a unit
        for xlo in range(0, len(xm), TILE_ROWS):
            for sides in bounds:
                left, right, q_low, q_up, x_up = sides()
                part = right[:, xlo:xlo + TILE_ROWS]
                low = np.matmul(left[lo:lo + TILE_QUERIES], part,
                                out=space.view(part.dtype)[:len(qs) * part.shape[1]].reshape(len(qs), -1))
                if part.shape[1] >= k and np.isinf(limit).any():
                    up = low + x_up[xlo:xlo + TILE_ROWS]
                    up.partition(k - 1, axis=1)
                    limit = np.fmin(limit, up[:, k - 1] + (q_low + q_up)[lo:lo + TILE_QUERIES] + 10.0 ** -ROUND)
                near = low <= _upward(limit - q_low[lo:lo + TILE_QUERIES], part.dtype)[:, None]
                if np.count_nonzero(near) * FEW < near.size:
                    break
            qi, xi = np.divmod(np.flatnonzero(near), near.shape[1])
            # ties and wide error bounds can select a whole tile: worked off in
            # slices of a fixed number of pairs, keeping k rows per query
            for a in range(0, len(qi), PAIR_STEP):
                qa, xa = qi[a:a + PAIR_STEP], xi[a:a + PAIR_STEP] + xlo
                d = np.round(_exact(qs[qa], xm[xa], metric), ROUND)
                kept = _topk_rows(*(np.concatenate(c) for c in zip(kept, (qa, xid[xa], d))), k)
            full = np.flatnonzero(np.bincount(kept[0], minlength=len(qs)) == k)
            if len(full):
                last = np.searchsorted(kept[0], full, "right") - 1
                limit[full] = np.fmin(limit[full], kept[2][last] + 10.0 ** -ROUND)
        found.append((qids[lo + kept[0]], kept[1], kept[2]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _n_blocks(n: int, rows: int, spread: int) -> int:
    """Blocks of at most ``rows`` rows; more (down to MIN_BLOCK_ROWS rows
    each) when that alone would leave cores idle."""
    need = -(-n // rows) if n else 1
    return max(1, need, min(spread, -(-n // MIN_BLOCK_ROWS)))


def _few(queries: DataFrame, dims: int, few_bytes: int) -> list | None:
    """The query rows when they take at most ``few_bytes`` as doubles, else None."""
    most = few_bytes // (8 * max(1, dims))
    rows = queries.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def _search_partitions(x: DataFrame, qids: np.ndarray, qm: np.ndarray, k: int, metric: str, id_col: str, schema: StructType) -> DataFrame:
    """At most k rows per query from each index partition; index rows stay where they are read."""

    def run(batches):
        kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64))
        place = np.arange(len(qids))
        for b in batches:
            if b.num_rows:
                qi, ids, d = _pair_topk(place, qm, b.column(0).to_numpy(), _matrix(b.column(1)), k, metric)
                kept = _topk_rows(*(np.concatenate(c) for c in zip(kept, (qi, ids, d))), k)
        yield pa.RecordBatch.from_arrays([pa.array(qids[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], ["query_id", id_col, "dist"])

    return x.mapInArrow(run, schema)


def nearest_batch(index: DataFrame, queries: DataFrame, k: int = DEFAULT_K, id_col: str = "vec_id",
                  vec_col: str = "embedding", query_id: str = "query_id", query_vec: str = "vector",
                  metric: str = "l2", max_block: int | None = None,
                  block_bytes: int = BLOCK_BYTES, few_bytes: int = FEW_BYTES) -> DataFrame:
    """V5: exact k nearest index rows for every query (blocked nested loop).

    Queries that take at most ``few_bytes`` travel to the index: every index
    partition keeps its k best rows per query, and no index row is shuffled.
    More queries are searched in blocks: queries and index rows are dealt into blocks of at most ``max_block``
    rows (by default what fits in ``block_bytes`` of vectors) by a hash of
    id and vector, so an id repeated with different vectors spreads over
    blocks, and a recomputed task deals rows exactly as before.  Every
    query block meets every index block in one cogroup task: each query row
    travels to the index blocks and each index row to the query blocks, and
    nothing passes through the driver.  Index rows without an id or a vector are left out.  A task keeps a running top-k per
    query and emits at most ``k`` rows per query; a window over those
    candidates (``k`` per index block) picks the final k.  Exact search is
    quadratic by nature: ``nearest_approx`` is the option for large query sets.
    """
    spark = index.sparkSession
    q = queries.select(F.col(query_id).cast("long").alias("__qid"), F.col(query_vec).alias("__qv")) \
        .where(F.col("__qv").isNotNull())
    x = index.select(F.col(id_col).cast("long").alias("__id"), F.col(vec_col).alias("__v")) \
        .where(F.col("__v").isNotNull() & F.col("__id").isNotNull())
    schema = StructType([StructField("query_id", LongType()), StructField(id_col, LongType()),
                         StructField("dist", DoubleType())])
    first = x.select("__v").first()  # one row: the vector width
    if first is None:
        empty = spark.createDataFrame([], schema.add(StructField("rank", LongType())))
        return empty.withColumnRenamed("query_id", query_id)
    width = 4 if isinstance(x.schema["__v"].dataType.elementType, FloatType) else 8
    few = _few(q, len(first[0]), few_bytes)
    if few is not None:
        cand = _search_partitions(x, np.array([r[0] for r in few], dtype=np.int64),
                                  np.array([r[1] for r in few], dtype=np.float64).reshape(len(few), -1), k, metric, id_col, schema)
        ranked = top_k_per_group(cand, ["query_id"], [F.col("dist"), F.col(id_col)], k)
        return ranked.withColumnRenamed("query_id", query_id)
    rows = max_block or max(1, block_bytes // (width * max(1, len(first[0]))))
    try:
        cores = spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - a client session without a local context
        cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # row counts of the inputs bound the non-null rows from above (blocks can
    # only come out smaller) and, on a plain Parquet scan, read no column
    n_q, n_x = queries.count(), index.count()
    b_q = _n_blocks(n_q, rows, 1)
    b_x = _n_blocks(n_x, rows, max(1, cores // b_q))
    # blocks from the row's own content, so a task recomputed after an
    # executor loss deals every row to the same block again.  Both keys are
    # int on both sides: the cogroup hash-partitions each side by its own key
    # types, and a long key would send a block to another partition than the
    # same int key.
    qb = (q.withColumn("__qb", F.pmod(F.xxhash64("__qid", "__qv"), F.lit(b_q)).cast("int"))
          .withColumn("__xb", F.explode(F.sequence(F.lit(0), F.lit(b_x - 1)))))
    xb = (x.withColumn("__xb", F.pmod(F.xxhash64("__id", "__v"), F.lit(b_x)).cast("int"))
          .withColumn("__qb", F.explode(F.sequence(F.lit(0), F.lit(b_q - 1)))))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        qi, ids, d = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64))
        if left.num_rows and right.num_rows:
            qi, ids, d = _pair_topk(left.column("__qid").to_numpy(), _matrix(left.column("__qv")),
                                    right.column("__id").to_numpy(), _matrix(right.column("__v")), k, metric)
        return pa.table({"query_id": pa.array(qi, pa.int64()), id_col: pa.array(ids, pa.int64()), "dist": pa.array(d, pa.float64())})

    cand = (qb.groupBy("__qb", "__xb").cogroup(xb.groupBy("__qb", "__xb"))
            .applyInArrow(pair, schema))
    # a query id repeated many times reaches its final window pre-cut
    ranked = top_k_per_group(cand, ["query_id"], [F.col("dist"), F.col(id_col)], k)
    return ranked.withColumnRenamed("query_id", query_id)


# ------------------------------------------------------------------ V6

# Planes are drawn once for so many; a table of n rows uses the first log2(n / BUCKET_ROWS) of each of N_TABLES tables.
MAX_PLANES, BUCKET_ROWS, N_TABLES, SEED = 40, 256, 8, 7
SKETCH_WORDS = 3  # 64 signs each
TARGET_RECALL, SAMPLE = 0.95, 256
PLACES = 9  # projections and their squares are compared after rounding


def _orthogonal(rng, planes: int, dim: int) -> np.ndarray:
    """Random unit planes, orthogonal to each other inside every block of ``dim``; plain decimal constants."""
    blocks = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-planes // dim))]
    return np.round(np.concatenate(blocks)[:planes], 6)


def hyperplanes(dim: int, n_tables: int = N_TABLES, seed: int = SEED) -> np.ndarray:
    """The fixed planes: (table, plane, dim); a prefix of the planes stays the same whatever the index size."""
    rng = np.random.default_rng(seed)
    return np.stack([_orthogonal(rng, MAX_PLANES, dim) for _ in range(n_tables)])


def sketch_planes(dim: int, words: int = SKETCH_WORDS, seed: int = SEED) -> np.ndarray:
    """The fixed planes of the sketch: (64 * words, dim)."""
    return _orthogonal(np.random.default_rng(seed + 1), 64 * words, dim)


def _project(m: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return np.round((m @ planes.reshape(-1, planes.shape[-1]).T).reshape(len(m), *planes.shape[:-1]), PLACES)


def _codes(projected: np.ndarray) -> np.ndarray:
    """Signs of the last axis as one integer, plane i at bit i."""
    return ((projected >= 0).astype(np.uint64) << np.arange(projected.shape[-1], dtype=np.uint64)).sum(-1, dtype=np.uint64)


def _sketches(m: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return _codes(_project(m, planes.reshape(-1, 64, planes.shape[-1])))


def _probed(margins: np.ndarray, limit: float):
    """For every row of ``margins`` all sets of planes (as bits) whose squared margins add up to at most ``limit``,
    the empty set included, as (row, set) pairs."""
    order = np.argsort(margins, axis=1)
    squares, bits = np.take_along_axis(margins, order, 1) ** 2, np.uint64(1) << order.astype(np.uint64)
    rows, masks, costs = np.arange(len(margins)), np.zeros(len(margins), dtype=np.uint64), np.zeros(len(margins))
    found = []
    for j in range(margins.shape[1]):
        more = costs + squares[rows, j]
        reach = more <= limit + 10.0 ** -PLACES
        # a set that this plane puts out of reach stays as it is: all planes to come are further off
        found.append((rows[~reach], masks[~reach], costs[~reach]))
        rows, masks, costs, more = rows[reach], masks[reach], costs[reach], more[reach]
        rows, masks, costs = np.tile(rows, 2), np.concatenate([masks, masks | bits[rows, j]]), np.concatenate([costs, more])
    rows, masks, costs = (np.concatenate(c) for c in zip(*found, (rows, masks, costs)))
    keep = (np.round(costs, PLACES) <= limit) | (masks == 0)
    return rows[keep], masks[keep]


def _probes(margins: np.ndarray, limit: float) -> np.ndarray:
    """All sets of planes (as bits) whose squared margins add up to at most ``limit``, the empty set included."""
    return _probed(margins[None], limit)[1]


def search_limits(index: DataFrame, planes: np.ndarray, sketch: np.ndarray, k: int, recall: float, id_col: str, vec_col: str,
                  sample: int = SAMPLE) -> tuple[float, int]:
    """How far a search must look for ``recall`` of the neighbours, from a sample of the index.

    The ``sample`` rows of least md5 of their id look for their true k neighbours (exact search, the row
    itself left out).  A neighbour's cost is the least, over the tables, of the squared
    distances from the row to the planes that part the two; its gap is the number of
    sketch signs that differ.  Either limit is the least that takes in the share
    (1 + recall) / 2 of the sample's neighbours, so both together take in ``recall``.
    """
    rows = index.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id"), F.col(vec_col).alias("__v"))
    asked = rows.orderBy(F.md5(F.col("__id").cast("string").cast("binary")), "__id").limit(sample).collect()
    spark = index.sparkSession
    few = spark.createDataFrame([(r[0], r[1]) for r in asked], rows.schema).select(F.col("__id").alias("__q"), F.col("__v").alias("__w"))
    found = nearest_batch(rows, few, k + 1, "__id", "__v", "__q", "__w")
    found = found.where(F.col("__id") != F.col("__q"))
    ranked = top_k_per_group(found.drop("rank"), ["__q"], [F.col("dist"), F.col("__id")], k)
    # at most k rows per sampled row, each with its vector
    pairs = F.broadcast(ranked.select("__q", "__id")).join(rows, "__id").select("__q", "__v").collect()
    if not pairs:
        return 0.0, 64 * SKETCH_WORDS
    own = {r[0]: r[1] for r in asked}
    a = np.array([own[p[0]] for p in pairs], dtype=np.float64)
    b = np.array([p[1] for p in pairs], dtype=np.float64)
    pa_, pb = _project(a, planes), _project(b, planes)
    cost = np.round((((pa_ >= 0) != (pb >= 0)) * pa_ ** 2).sum(-1), PLACES).min(-1)
    gap = np.bitwise_count(_sketches(a, sketch) ^ _sketches(b, sketch)).sum(-1)
    place = max(1, int(np.ceil(round((1 + recall) / 2 * len(pairs), 6)))) - 1
    return float(np.sort(cost)[place]), int(np.sort(gap)[place])


def _group_of(tables: np.ndarray, buckets: np.ndarray, groups: int) -> np.ndarray:
    mixed = (buckets + tables.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(31)) % np.uint64(groups)).astype(np.int32)


def _looked_into(qm: np.ndarray, planes: np.ndarray, buckets: np.ndarray, reach: float) -> np.ndarray:
    """Whether each bucket (a row; table and code) lies within ``reach`` of each query (a column), as ``_probes`` tells."""
    out = np.zeros((len(buckets), len(qm)), dtype=bool)
    tables, codes = buckets >> np.uint64(MAX_PLANES), buckets & np.uint64((1 << MAX_PLANES) - 1)
    for t in np.unique(tables):
        at, own = np.flatnonzero(tables == t), _project(qm, planes[int(t)])
        squares, sign = own ** 2, own >= 0
        bits = (codes[at][:, None] >> np.arange(own.shape[1], dtype=np.uint64) & np.uint64(1)).astype(bool)
        costs = np.concatenate([bits, ~bits], axis=1).astype(np.float64) @ np.concatenate([squares * ~sign, squares * sign], axis=1).T
        out[at] = (np.round(costs, PLACES) <= reach) | (codes[at][:, None] == _codes(own)[None, :])
    return out


def _candidates(qcodes: np.ndarray, qm: np.ndarray, qs: np.ndarray, xcodes: np.ndarray, xm: np.ndarray, xs: np.ndarray, gap: int,
                limit: np.ndarray | None = None):
    """Pairs (query, index row) that meet in a bucket and whose sketches differ in at most ``gap`` signs, a tile at a time.

    ``qcodes`` are (query, bucket) pairs as two rows.  With ``limit``, a squared distance for each query that the
    caller may lower after every tile, pairs further apart by a bound from below are left out; their sketches are not compared."""
    order, qorder = np.argsort(xcodes, kind="stable"), np.argsort(qcodes[1], kind="stable")
    sorted_x, sorted_q = xcodes[order], qcodes[1][qorder]
    xs, bounds = xs[order], [] if limit is None else _bounds(qm, xm[order], "l2")
    space = np.empty(QUERY_STEP * INDEX_STEP if bounds else 0)
    for code in np.intersect1d(sorted_q, sorted_x):
        lo, hi = np.searchsorted(sorted_x, code), np.searchsorted(sorted_x, code, "right")
        q = qcodes[0][qorder[np.searchsorted(sorted_q, code):np.searchsorted(sorted_q, code, "right")]].astype(np.int64)
        step = QUERY_STEP * INDEX_STEP // min(hi - lo, INDEX_STEP)
        for a in range(0, len(q), step):
            qa = q[a:a + step]
            for c in range(lo, hi, INDEX_STEP):
                end = min(c + INDEX_STEP, hi)
                met, few = np.ones((len(qa), end - c), dtype=bool), False
                for sides in bounds:
                    left, right, q_low, *_ = sides()
                    low = np.matmul(left[qa], right[:, c:end], out=space.view(left.dtype)[:met.size].reshape(met.shape))
                    met &= ~(low > _upward(limit[qa] - q_low[qa], left.dtype)[:, None])
                    few = np.count_nonzero(met) * FEW < met.size
                    if few:
                        break
                if not few:
                    met &= _apart(qs[qa][:, None], xs[None, c:end]) <= gap
                i, j = np.divmod(np.flatnonzero(met), met.shape[1])
                if few:
                    close = _apart(qs[qa[i]], xs[c + j]) <= gap
                    i, j = i[close], j[close]
                if len(i):
                    yield qa[i], order[c + j]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signs in which sketches differ; the words are the last axis."""
    out = 0
    for w in range(a.shape[-1]):
        out = out + np.bitwise_count(a[..., w] ^ b[..., w]).astype(np.uint8 if 64 * a.shape[-1] < 256 else np.uint16, copy=False)
    return out


class _Best:
    """The k nearest distinct ids found so far for each of ``n`` queries."""

    def __init__(self, n: int, k: int, limit: np.ndarray):
        self.k, self.held, self.ids, self.d = k, np.zeros(n, dtype=np.int64), np.zeros((n, k), dtype=np.int64), np.zeros((n, k))
        self.limit = limit  # no neighbour of a query is further away; rounding moves either side by half a unit

    def may(self, qi: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether rows may be among the k, whatever their distance: not after k smaller ids at distance 0."""
        return (self.held[qi] < self.k) | (self.d[qi, -1] != 0) | (ids < self.ids[qi, -1])

    def add(self, qi: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        """Takes in more rows, in any order; only queries that one of them may be among the k of are gone through."""
        last, last_id = self.d[qi, -1], self.ids[qi, -1]
        may = ~((self.held[qi] == self.k) & ((d > last) | (d == last) & (ids >= last_id)))
        qi, ids, d = qi[may], ids[may], d[may]
        who, qi = np.unique(qi, return_inverse=True)
        old, rank = np.nonzero(np.arange(self.k) < self.held[who][:, None])
        qi, ids, d = _topk_rows(*_distinct(np.concatenate([old, qi]), np.concatenate([self.ids[who[old], rank], ids]),
                                           np.concatenate([self.d[who[old], rank], d])), self.k)
        held = np.bincount(qi, minlength=len(who))
        rank = np.arange(len(qi)) - np.repeat(np.cumsum(held) - held, held)
        self.held[who], self.ids[who[qi], rank], self.d[who[qi], rank] = held, ids, d
        full = who[held == self.k]
        self.limit[full] = np.fmin(self.limit[full], self.d[full, -1] + 10.0 ** -ROUND)

    def rows(self):
        qi, rank = np.nonzero(np.arange(self.k) < self.held[:, None])
        return qi, self.ids[qi, rank], self.d[qi, rank]


def _seed_limits(qm: np.ndarray, qs: np.ndarray, projected: np.ndarray, seeds: tuple, reach: float, gap: int, k: int) -> np.ndarray:
    """A distance for each query that its k-th neighbour does not exceed, from what it would find among a few
    index rows (ids, vectors, sketches, projections); infinite if it would not find k."""
    ids, xm, xs, at = seeds
    best = _Best(len(qm), k, np.full(len(qm), np.inf))
    most = min(SEED_NEAR * k, len(ids))
    step = max(1, min(QUERY_STEP, PAIR_STEP // 8 // max(1, most)))
    for a in range(0, len(qm) if most else 0, step):
        near = np.argpartition((xm * xm).sum(1) - 2 * qm[a:a + step] @ xm.T, most - 1, axis=1)[:, :most]
        qi, xi = np.repeat(np.arange(a, a + len(near)), most), near.reshape(-1)
        close = _apart(qs[qi], xs[xi]) <= gap
        qi, xi = qi[close], xi[close]
        own = projected[qi]
        meet = np.round((((own >= 0) != (at[xi] >= 0)) * own ** 2).sum(-1), PLACES).min(-1) <= reach
        qi, xi = qi[meet], xi[meet]
        best.add(qi, ids[xi], np.round(_exact(qm[qi], xm[xi], "l2"), ROUND))
    return best.limit


def nearest_approx(index: DataFrame, queries: DataFrame, k: int = DEFAULT_K, id_col: str = "vec_id",
                   vec_col: str = "embedding", query_id: str = "query_id", query_vec: str = "vector",
                   n_tables: int = N_TABLES, bucket_rows: int = BUCKET_ROWS, seed: int = SEED,
                   target_group: int = 50_000, recall: float = TARGET_RECALL) -> DataFrame:
    """V6: approximate k nearest by hyperplane hashing, query-directed probes and a sketch.

    Each of ``n_tables`` tables gives every vector a bucket from the signs of its projections on
    log2(rows / ``bucket_rows``) planes, so buckets stay about ``bucket_rows`` rows however
    large the index is.  A query looks into every bucket that it could reach by crossing planes
    whose squared distances add up to at most a limit; rows met so are compared exactly if
    they may be among its k nearest (by one product of a bucket and the queries that look into it) and
    their sketches (signs on further planes) differ in few enough places.  Both limits
    come from ``search_limits``, so the share of true neighbours found stays at
    ``recall`` as planes are added; an index of one bucket per table is searched whole.

    Buckets are dealt to tasks in groups of about ``target_group`` rows; a larger group (a
    crowded bucket) is cut on both sides, and every query part meets every index part.  A query
    travels once to each group that it looks into.  Only k rows per query and group leave a task.

    Every query is returned: ``short`` marks those with fewer than k
    neighbours found, and one without any (an empty index, a null vector)
    has one row with a null id.
    """
    spark = index.sparkSession
    asked = queries.select(F.col(query_id).cast("long").alias("__qid"), F.col(query_vec).alias("__qv"))
    x = index.select(F.col(id_col).cast("long").alias("__id"), F.col(vec_col).alias("__v")).where(F.col("__v").isNotNull() & F.col("__id").isNotNull())
    first = x.select("__v").first()
    ids = asked.select("__qid").distinct()
    if first is None:
        return ids.select(F.col("__qid").alias(query_id), F.lit(None).cast("long").alias(id_col), F.lit(None).cast("double").alias("dist"),
                          F.lit(None).cast("long").alias("rank"), F.lit(True).alias("short"))
    n = index.count()
    n_planes = min(MAX_PLANES, max(0, int(np.ceil(np.log2(max(n, 1) / bucket_rows)))))
    planes, sketch = hyperplanes(len(first[0]), n_tables, seed)[:, :n_planes], sketch_planes(len(first[0]), seed=seed)
    reach, gap = search_limits(x, planes, sketch, k, recall, "__id", "__v") if n_planes else (0.0, 64 * SKETCH_WORDS)
    groups = max(1, -(-n * n_tables // target_group))
    table = np.arange(n_tables, dtype=np.uint64)
    n_seeds = SEED_BYTES // (8 * max(1, len(first[0]))) if n_planes else 0
    held = x.orderBy(F.xxhash64("__id", "__v")).limit(n_seeds).collect() if n_seeds else []
    seed_m = np.array([r[1] for r in held], dtype=np.float64).reshape(len(held), -1 if held else len(first[0]))
    seeds = (np.array([r[0] for r in held], dtype=np.int64), seed_m, _sketches(seed_m, sketch), _project(seed_m, planes))

    def index_groups(m) -> tuple:
        t, codes = np.tile(table, len(m)), _codes(_project(m, planes)).reshape(-1)
        return codes | t << np.uint64(MAX_PLANES), _group_of(t, codes, groups)

    def query_groups(projected) -> tuple:
        who, into = [], []
        step = max(1, PROBE_CELLS // (n_tables << n_planes))
        for a in range(0, len(projected), step):
            part = projected[a:a + step]
            row, masks = _probed(np.abs(part).reshape(len(part) * n_tables, n_planes), reach)
            hit = np.zeros((len(part), groups), dtype=bool)
            hit[row // n_tables, _group_of(table[row % n_tables], masks ^ _codes(part).reshape(-1)[row], groups)] = True
            i, g = np.nonzero(hit)
            who.append(a + i)
            into.append(g)
        return np.concatenate(who), np.concatenate(into).astype(np.int32)

    def counted(groups_of):
        def run(batches):
            for b in batches:
                if b.num_rows:
                    g, n = np.unique(groups_of(_matrix(b.column(0))), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], ["__g", "__n"])
        return run

    def sent(b, who, words, more) -> pa.RecordBatch:
        who = pa.array(who)
        return pa.RecordBatch.from_arrays([c.take(who) for c in (b.column(0), b.column(1), *(pa.array(w) for w in words.view(np.int64).T))]
                                          + [pa.array(c) for c in more.values()], [*b.schema.names, *sketch_cols, *more])

    def index_buckets(batches):
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1))
                codes, into = index_groups(m)
                yield sent(b, np.repeat(np.arange(len(m)), n_tables), _sketches(m, sketch), {"__b": codes.view(np.int64), "__g": into})

    def query_buckets(batches):
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1))
                projected, words = _project(m, planes), _sketches(m, sketch)
                who, into = query_groups(projected)
                yield sent(b, who, words, {"__lim": _seed_limits(m, words, projected, seeds, reach, gap, k)[who], "__g": into})

    sketch_cols = [f"__s{w}" for w in range(SKETCH_WORDS)]
    words = ", ".join(f"{c} long" for c in sketch_cols)
    asked_for = asked.where(F.col("__qv").isNotNull() & F.col("__qid").isNotNull())
    idx = x.mapInArrow(index_buckets, f"__id long, __v {x.schema['__v'].dataType.simpleString()}, {words}, __b long, __g int")
    qs = asked_for.mapInArrow(query_buckets, f"__qid long, __qv {asked.schema['__qv'].dataType.simpleString()}, {words}, __lim double, __g int")
    # groups above the target are cut; all others are one part on either side.  Their sizes come from
    # a pass of its own that sends numbers only: at most a row for each group
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.sum(c) / target_group)).cast("int")
    cut = F.broadcast(
        x.select("__v").mapInArrow(counted(lambda m: index_groups(m)[1]), "__g int, __n long").groupBy("__g").agg(parts("__n").alias("__si"))
        .join(asked_for.select("__qv").mapInArrow(counted(lambda m: query_groups(_project(m, planes))[1]), "__g int, __n long")
              .groupBy("__g").agg(parts("__n").alias("__sq")), "__g"))
    idx = idx.join(cut, "__g").select(
        "__id", "__v", *sketch_cols, "__b", "__g", F.pmod(F.xxhash64("__id", "__v"), F.col("__si")).cast("int").alias("__is"),
        F.explode(F.sequence(F.lit(0), F.col("__sq") - 1)).alias("__qs"))
    qs = qs.join(cut, "__g").select(
        "__qid", "__qv", *sketch_cols, "__lim", "__g", F.pmod(F.xxhash64("__qid", "__qv"), F.col("__sq")).cast("int").alias("__qs"),
        F.explode(F.sequence(F.lit(0), F.col("__si") - 1)).alias("__is"))

    def group_topk(left: pa.Table, right: pa.Table) -> pa.Table:
        qid, found = np.empty(0, np.int64), (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64))
        if left.num_rows and right.num_rows:
            qid, xid, codes = (c.to_numpy() for c in (left.column("__qid"), right.column("__id"), right.column("__b")))
            qm, xm = _matrix(left.column("__qv")), _matrix(right.column("__v"))
            qw, xw = (np.stack([f.column(c).to_numpy().view(np.uint64) for c in sketch_cols], axis=1) for f in (left, right))
            best = _Best(len(qm), k, left.column("__lim").to_numpy().copy())
            buckets = np.unique(codes)
            step = max(1, LOOK_CELLS // len(buckets))
            for lo in range(0, len(qm), step):
                part = slice(lo, lo + step)
                into, who = np.nonzero(_looked_into(qm[part], planes, buckets.view(np.uint64), reach))
                asked_in = np.stack([who, buckets[into]])
                for qi, xi in _candidates(asked_in, qm[part], qw[part], codes, xm, xw, gap, best.limit[part]):
                    for a in range(0, len(qi), PAIR_STEP):
                        q, r = lo + qi[a:a + PAIR_STEP], xi[a:a + PAIR_STEP]
                        may = best.may(q, xid[r])
                        q, r = q[may], r[may]
                        best.add(q, xid[r], np.round(_exact(qm[q], xm[r], "l2"), ROUND))
            found = best.rows()
        return pa.table({"query_id": pa.array(qid[found[0]], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "dist": pa.array(found[2], pa.float64())})

    keys = ["__g", "__is", "__qs"]
    cand = qs.groupBy(*keys).cogroup(idx.groupBy(*keys)).applyInArrow(group_topk, "query_id long, vec_id long, dist double")
    # a neighbour found in several groups is one candidate
    cand = cand.groupBy("query_id", "vec_id").agg(F.min("dist").alias("dist"))
    ranked = top_k_per_group(cand, ["query_id"], [F.col("dist"), F.col("vec_id")], k)
    sizes = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("__n"))
    out = ids.join(ranked.join(sizes, "query_id"), F.col("__qid") == F.col("query_id"), "left")
    return out.select(F.col("__qid").alias(query_id), F.col("vec_id").alias(id_col), "dist", "rank",
                      (F.coalesce("__n", F.lit(0)) < k).alias("short"))


def recall_at_k(approx: DataFrame, exact: DataFrame, query_id: str = "query_id", id_col: str = "vec_id") -> DataFrame:
    """Share of exact neighbours the approximate search found, overall."""
    hit = exact.join(approx.select(query_id, id_col).withColumn("__hit", F.lit(1)), [query_id, id_col], "left")
    return hit.agg((F.count("__hit") / F.count(F.lit(1))).alias("recall"))


# ------------------------------------------------------------------ V7

def assemble_context(hits: DataFrame, query_id: str = "query_id", rank: str = "rank",
                     text: str = "text", separator: str = CONTEXT_SEPARATOR) -> DataFrame:
    """V7: each hit's text followed by the separator, in rank order
    (including after the last hit)."""
    grouped = hits.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct(rank, text))).alias("__h"))
    return grouped.select(query_id, F.array_join(
        F.transform("__h", lambda h: F.concat(F.coalesce(h[text], F.lit("")), F.lit(separator))), "").alias("context"))
