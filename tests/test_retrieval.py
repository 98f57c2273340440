"""The retrieval chain, snapshots and searches that hold their recall."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.operators import retrieval as R
from storelens.operators import vectors as V
from storelens.operators.chunking import split_spans
from storelens.session import scratch_path
from storelens.sources.snapshots import Conflict, SnapshotTable
from tests.conftest import SF_SMALL


def plain_vectors(texts, dims):
    """Feature hashing with dictionaries, text by text."""
    bags = [Counter(int(hashlib.md5(w.encode()).hexdigest()[:5], 16) for w in re.findall(r"[^\W_]+", (t or "").lower())) for t in texts]
    seen = Counter(f for bag in bags for f in bag)

    def vector(text):
        out = [0] * dims
        for f, c in Counter(int(hashlib.md5(w.encode()).hexdigest()[:5], 16) for w in re.findall(r"[^\W_]+", (text or "").lower())).items():
            weight = round(100 * (math.log((1 + len(texts)) / (1 + seen[f])) + 1))
            out[f % dims] += (1 if f // dims % 2 == 0 else -1) * round(weight * (1 + math.log(c)))
        return out

    return vector


def test_vectors_and_hits_equal_a_plain_search(spark):
    docs = [(i, r["text"]) for i, r in enumerate(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").limit(40).collect())]
    docs += [(100, None), (101, ""), (102, " .. !! "), (103, docs[3][1]), (104, "Ünïcode ÄÖÜ straße ЖЗ 42"), (None, "lost")]
    index = R.ChunkIndex(spark, scratch_path(spark, "test-index"))
    index.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), dims=64)
    chunks = [(d * R.CHUNKS_PER_DOC + i if d is not None else None, t[s:e]) for d, t in docs if t for i, (s, e) in enumerate(split_spans(t))]
    vector = plain_vectors([c for _, c in chunks], 64)
    got = {r.chunk_id: (r.chunk_text, list(r.embedding)) for r in index.chunks.read().collect()}
    assert got == {i: (c, [float(x) for x in vector(c)]) for i, c in chunks}

    phrases = [(1, docs[3][1][40:140]), (2, "ЖЗ 42"), (3, None), (4, "zzz unknownword"), (5, docs[7][1][:80])]
    hits = index.search(spark.createDataFrame(phrases, "phrase_id long, phrase string"), 3).collect()
    for p, phrase in phrases:
        q = np.array(vector(phrase), dtype=float)
        dist = []
        for i, c in chunks:
            x = np.array(vector(c), dtype=float)
            norms = np.sqrt(q @ q) * np.sqrt(x @ x)
            if i is not None:
                dist.append((round(1 - (q @ x) / norms, 6) if norms else 1.0, i))
        mine = sorted((r.rank, r.dist, r.chunk_id) for r in hits if r.phrase_id == p)
        assert [(d, i) for _, d, i in mine] == sorted(dist)[:3]
        assert all(r.chunk_text == dict(chunks)[r.chunk_id] and r.doc_id == r.chunk_id // R.CHUNKS_PER_DOC for r in hits if r.phrase_id == p)
    context = {r.phrase_id: r.context for r in index.contexts(spark.createDataFrame(phrases, "phrase_id long, phrase string")).collect()}
    assert context[2].startswith("Ünïcode ÄÖÜ straße ЖЗ 42" + V.CONTEXT_SEPARATOR) and context[2].count(V.CONTEXT_SEPARATOR) == 3


# -- V5, V6

def test_few_and_many_queries_find_the_same(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").repartition(3)
    q = e.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    for metric in ("l2", "cosine", "dot"):
        few = sorted(map(tuple, V.nearest_batch(e, q, 5, metric=metric).collect()))
        assert few == sorted(map(tuple, V.nearest_batch(e, q, 5, metric=metric, few_bytes=0).collect())) and few
    plan = V.nearest_batch(e, q)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan


@pytest.mark.parametrize("planes", [3, 8, 12])
def test_recall_is_held_whatever_the_planes(spark, planes):
    """Random directions, the hardest case: brute force on ids divisible by 50, the row itself left out."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    held = e.toPandas()
    ids, x = held.vec_id.to_numpy(), np.stack(held.embedding.to_numpy()).astype(float)
    rows = np.flatnonzero(ids % 50 == 0)
    d = ((x[rows] ** 2).sum(1)[:, None] + (x ** 2).sum(1)[None] - 2 * x[rows] @ x.T)
    d[np.arange(len(rows)), rows] = np.inf
    true = np.argsort(d, axis=1)[:, :3]
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = V.nearest_approx(e, q, k=4, bucket_rows=len(x) / 2 ** planes).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[ids[i]] & set(ids[t])) / 3 for i, t in zip(rows, true)])
    assert recall >= 0.9
    sketch, tables = V.sketch_planes(64), V.hyperplanes(64)[:, :planes]
    reach, gap = V.search_limits(e, tables, sketch, 4, V.TARGET_RECALL, "vec_id", "embedding")
    words, at = V._sketches(x, sketch), V._project(x, tables)
    share = np.mean([((((at >= 0) != (at[i] >= 0)) * at[i] ** 2).sum(-1).min(-1) <= reach)[None]
                     & (np.bitwise_count(words ^ words[i]).sum(-1) <= gap)[None] for i in rows])
    assert planes < 12 or share < 0.1  # of the index compared exactly


def test_probes_are_all_sets_of_planes_within_the_limit():
    r = np.random.default_rng(2)
    for _ in range(50):
        m = np.round(np.abs(r.normal(size=7)), V.PLACES)
        limit = float(r.choice([0.0, 0.3, 1.0, 5.0]))
        cost = [(mask, round(sum(m[i] ** 2 for i in range(7) if mask >> i & 1), V.PLACES)) for mask in range(128)]
        assert sorted(V._probes(m, limit).tolist()) == sorted(mask for mask, c in cost if c <= limit or mask == 0)


# -- S3, Q7 as snapshots

def _table(spark, n=1000):
    table = SnapshotTable(spark, scratch_path(spark, "test-snapshots"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table.save(spark.range(n).select("id", (F.col("id") % 10).alias("v"), F.lit("a").alias("s")), key="id")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return table


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_an_edit_of_one_key_rewrites_one_file(spark):
    table = _table(spark)
    before = {f["path"] for f in table.manifest()["files"]}
    assert len(before) > 2
    old = table.read()
    assert table.update(F.col("id") == 7, {"s": F.lit("b")}, keys=(7, 7)) == (2, 1)
    after = {f["path"] for f in table.manifest()["files"]}
    assert len(before - after) == 1 and len(after - before) == 1
    assert _rows(table.read()) == sorted((i, i % 10, "b" if i == 7 else "a") for i in range(1000))
    assert _rows(old) == _rows(table.read(1)) == sorted((i, i % 10, "a") for i in range(1000))  # readers keep their snapshot


def test_edits_count_rows_and_take_null_as_no(spark):
    table = _table(spark, 100)
    assert table.update(F.col("v") == 3, {"s": F.lit("a")}) == (1, 0)  # nothing changes, nothing is published
    assert table.update(F.when(F.col("v") == 3, True), {"s": F.lit("c"), "v": F.col("v") + 100})[1] == 10
    assert table.delete(F.when(F.col("id") > 50, F.lit(None).cast("boolean")).otherwise(F.col("id") < 5))[1] == 5
    assert table.delete(F.col("id") >= 0, keys=(60, 69))[1] == 10
    table.append(spark.createDataFrame([(500, 1, "z")], "id long, v long, s string"))
    want = [(i, i % 10 + (100 if i % 10 == 3 else 0), "c" if i % 10 == 3 else "a") for i in range(5, 100) if not 60 <= i <= 69]
    assert _rows(table.read()) == sorted([*want, (500, 1, "z")])
    assert table.delete(F.lit(True))[1] == len(want) + 1 and table.read().count() == 0 and table.read().columns == ["id", "v", "s"]


def test_an_interrupted_save_leaves_the_old_version(spark):
    table = _table(spark, 50)
    broken = spark.range(50).select("id", F.raise_error(F.lit("cut off")).cast("long").alias("v"), F.lit("x").alias("s"))
    with pytest.raises(Exception, match="cut off"):
        table.save(broken)
    assert table.versions() == [1] and table.read().count() == 50
    table.save(table.read().where("id < 10"))  # may read the table that it replaces
    assert table.read().count() == 10


def test_conflicting_writers_are_told(spark):
    table = _table(spark, 20)
    held = table.manifest()
    other = SnapshotTable(spark, table.path)
    other.append(spark.createDataFrame([(99, 1, "o")], "id long, v long, s string"))
    with pytest.raises(Conflict):
        table._publish(held["version"], table.read().schema, "id", held["files"])
    assert table.read().count() == 21 and table.versions() == [1, 2]
    with pytest.raises(FileNotFoundError):
        SnapshotTable(spark, table.path + "-none").read()
