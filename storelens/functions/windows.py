"""Ordered-window helpers that never put a whole key in one task.

A window partitioned by a key alone sends every row of a hot key (say a third
of all rows) to one task.  These helpers add a time bucket to the partition:
the window runs per (key, bucket), and the value that crosses a bucket
boundary comes from a per-(key, bucket) summary (one row per key and bucket),
which is small enough to window per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from storelens.session import cut_lineage

BUCKET = "__bucket"


def floor_div(x: Column, y: int) -> Column:
    """Integer floor division (exact for any sign)."""
    return ((x - F.pmod(x, F.lit(y))) / F.lit(y)).cast("long")


def with_bucket(df: DataFrame, ts: str, bucket_us: int) -> DataFrame:
    return df.withColumn(BUCKET, floor_div(F.col(ts), bucket_us))


def with_rank_bucket(df: DataFrame, keys, order: Sequence[str], rows: int) -> DataFrame:
    """Buckets of about ``rows`` rows by rank in (keys, order) instead of by time.

    Rows are range-partitioned by key and order and a bucket is a partition, so an id that holds a third of
    all rows within minutes is spread over many buckets, still in order.  Only one summary
    row per (key, bucket) crosses over, as with time buckets.  The placed rows are written to the checkpoint
    folder: a range partition's bounds are sampled, and must be the same for all that reads them.
    """
    parts = max(1, -(-df.count() // rows))
    placed = df.repartitionByRange(parts, *_keys(keys), *order)
    return cut_lineage(placed.withColumn(BUCKET, F.spark_partition_id().cast("long")))


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def lag_across(df: DataFrame, keys, ts: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Previous ``value`` per key in ``order`` (``df`` must carry the bucket)."""
    keys = _keys(keys)
    w = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    df = df.withColumn("__in", F.lag(value).over(w))
    last_of_bucket = df.groupBy(*keys, BUCKET).agg(
        F.max(F.struct(*[F.col(c) for c in order], F.col(value).alias("__v")))["__v"].alias("__last"))
    wb = Window.partitionBy(*keys).orderBy(BUCKET)
    carry = last_of_bucket.select(*keys, BUCKET, F.lag("__last").over(wb).alias("__carry"))
    return (df.join(carry, [*keys, BUCKET])
            .withColumn(out, F.coalesce("__in", "__carry")).drop("__in", "__carry"))


def lead_across(df: DataFrame, keys, ts: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Next ``value`` per key in ``order`` (``df`` must carry the bucket)."""
    keys = _keys(keys)
    w = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    df = df.withColumn("__in", F.lead(value).over(w))
    first_of_bucket = df.groupBy(*keys, BUCKET).agg(
        F.min(F.struct(*[F.col(c) for c in order], F.col(value).alias("__v")))["__v"].alias("__first"))
    wb = Window.partitionBy(*keys).orderBy(BUCKET)
    carry = first_of_bucket.select(*keys, BUCKET, F.lead("__first").over(wb).alias("__carry"))
    return (df.join(carry, [*keys, BUCKET])
            .withColumn(out, F.coalesce("__in", "__carry")).drop("__in", "__carry"))


def running_last_across(df: DataFrame, keys, order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Latest non-null ``value`` up to and including each row, per key."""
    keys = _keys(keys)
    df = df.withColumn("__val", value)
    w = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__in", F.last("__val", ignorenulls=True).over(w))
    last_of_bucket = df.groupBy(*keys, BUCKET).agg(
        F.max(F.when(F.col("__val").isNotNull(),
                     F.struct(*[F.col(c) for c in order], F.col("__val").alias("__v"))))["__v"].alias("__last"))
    wb = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = last_of_bucket.select(*keys, BUCKET, F.last("__last", ignorenulls=True).over(wb).alias("__carry"))
    return (df.join(carry, [*keys, BUCKET], "left")
            .withColumn(out, F.coalesce("__in", "__carry")).drop("__in", "__carry", "__val"))


def running_sum_across(df: DataFrame, keys, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Running sum of ``value`` up to and including each row, per key (null
    until the first non-null value, like SQL's running ``SUM``)."""
    keys = _keys(keys)
    w = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(*keys, BUCKET).agg(F.sum(value).alias("__n"))
    wb = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select(*keys, BUCKET, F.sum("__n").over(wb).alias("__off"))
    inner = F.sum(value).over(w)
    total = F.when(F.col("__off").isNull() & inner.isNull(), F.lit(None)) \
        .otherwise(F.coalesce(F.col("__off"), F.lit(0)) + F.coalesce(inner, F.lit(0)))
    return df.join(offset, [*keys, BUCKET]).withColumn(out, total).drop("__off")


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, out: str = "rank",
                    method: str = "row_number", salt_by: Sequence[str] | None = None,
                    salts: int | None = None) -> DataFrame:
    """Rows ranked ``<= k`` inside each group, without ranking a whole group
    in one task.

    For ``k`` up to the optimizer's window group limit threshold a single
    window suffices: Spark plans a partial ``WindowGroupLimit`` before the
    exchange, so each map task sends at most ``k`` rows per group (plus
    ties for ``rank``/``dense_rank``) and a hot group arrives pre-cut.  Above
    the threshold two phases do the same by hand: phase one ranks inside
    ``salts`` hash sub-groups of each group (as many as there are shuffle partitions) and keeps rank ``<= k`` (a row
    in the group's top k is also in its sub-group's top k, so nothing is
    lost); phase two ranks only those survivors.
    """
    fn = {"row_number": F.row_number, "dense_rank": F.dense_rank, "rank": F.rank}[method]
    group = list(group)
    w2 = Window.partitionBy(*group).orderBy(*order)
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k <= threshold:
        return df.withColumn(out, fn().over(w2).cast("long")).where(F.col(out) <= k)
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt_cols = list(salt_by) if salt_by else df.columns
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*salt_cols), F.lit(salts)))
    w1 = Window.partitionBy(*group, "__salt").orderBy(*order)
    survivors = salted.withColumn("__r1", fn().over(w1)).where(F.col("__r1") <= k).drop("__r1", "__salt")
    return survivors.withColumn(out, fn().over(w2).cast("long")).where(F.col(out) <= k)
