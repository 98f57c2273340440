"""Connected components by alternating star contraction, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import written_in_few


def _with_least(edges: DataFrame) -> DataFrame:
    """u, v and m, the least of u and its neighbours.  The minimum is a
    partial-aggregated count-like aggregate; the join back can be split by AQE
    when one node has very many neighbours."""
    least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("lv"))
    return edges.join(least, F.col("u") == F.col("w")).select("u", "v", F.least("u", "lv").alias("m"))


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and its component's least node, for every node of ``edges(u, v)``.

    Each round replaces edges by shorter ones towards the least neighbour
    (large star, then small star); rounds grow with the logarithm of the longest
    path.  Rounds are cut with checkpoint().
    """
    stars = written_in_few(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(stars)
    while mark[0]:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large)
        stars = written_in_few(small.select("u", F.col("m").alias("v"))
                             .union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
        seen = _mark(stars)
        if seen == mark:
            break
        mark = seen
    return stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
