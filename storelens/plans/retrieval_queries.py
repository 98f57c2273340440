"""Registered queries of the retrieval chain: ``documents`` to chunks, vectors, stored index and
the context of every ``benchmark`` phrase; and of the snapshots behind it."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.functions.text import sql_literal
from storelens.operators import retrieval as R
from storelens.operators import vectors as V
from storelens.operators.phrases import PhraseIndex
from storelens.plans.chunk_sql import chunk_ctes
from storelens.plans.registry import query
from storelens.session import cut_lineage, drop_scratch, scratch_path
from storelens.sources.snapshots import SnapshotTable

# A text's features: words by the rule of the operator, the first hex digits of their md5.
_FEATURES = (f"list_transform(regexp_extract_all(lower(coalesce({{}}, '')), '[\\pL\\pN]+'), "
             f"lambda w: ('0x' || substr(md5(w), 1, {R.FEATURE_DIGITS}))::BIGINT)")

VECTOR_CTES = f"""{chunk_ctes()},
ch AS MATERIALIZED (SELECT doc_id * {R.CHUNKS_PER_DOC} + chunk_no AS chunk_id, chunk_text FROM chunks),
cf AS MATERIALIZED (SELECT chunk_id, f, count(*) AS n FROM (SELECT chunk_id, unnest({_FEATURES.format('chunk_text')}) AS f FROM ch) GROUP BY ALL),
idf AS MATERIALIZED (SELECT f, round({R.SCALE} * (ln((1 + (SELECT count(*) FROM ch)) / (1 + count(*))::DOUBLE) + 1)) AS w FROM cf GROUP BY f),
cv AS MATERIALIZED (
  SELECT chunk_id, d, v FROM (
    SELECT chunk_id, f % {R.DIMS} AS d, sum(CASE WHEN (f // {R.DIMS}) % 2 = 0 THEN 1 ELSE -1 END * round(w * (1 + ln(n)))) AS v
    FROM cf JOIN idf USING (f) GROUP BY ALL) WHERE v <> 0)"""


@query("v10_chunk_vectors", f"""
WITH RECURSIVE {VECTOR_CTES}
SELECT ch.chunk_id, count(v) AS n_filled, coalesce(sum(v), 0)::BIGINT AS total, coalesce(sum(v * v), 0)::BIGINT AS square,
       coalesce(sum((d + 1) * v), 0)::BIGINT AS placed
FROM ch LEFT JOIN cv USING (chunk_id) GROUP BY ch.chunk_id""")
def chunk_vectors(t):
    """V3 over chunks: every chunk's vector, by its filled dimensions, sum, square sum and place-weighted sum."""
    path = scratch_path(t.spark, "v10-index")
    index = R.ChunkIndex(t.spark, path)
    index.build(t.documents)
    v = F.transform("embedding", lambda x: x.cast("double"))

    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda a, b: a + b).cast("long")

    out = cut_lineage(index.chunks.read().withColumn("v", v).select(
        "chunk_id", F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("n_filled"), total(F.col("v")).alias("total"),
        total(F.transform("v", lambda x: x * x)).alias("square"), total(F.transform("v", lambda x, i: x * (i + 1))).alias("placed")))
    drop_scratch(path)
    return out


@query("v10_phrase_context", f"""
WITH RECURSIVE {VECTOR_CTES},
qf AS (SELECT item_id, f, count(*) AS n FROM (SELECT item_id, unnest({_FEATURES.format('text')}) AS f FROM benchmark) GROUP BY ALL),
qv AS MATERIALIZED (
  SELECT item_id, f % {R.DIMS} AS d,
         sum(CASE WHEN (f // {R.DIMS}) % 2 = 0 THEN 1 ELSE -1 END * round(coalesce(w, (SELECT round({R.SCALE} * (ln(1 + count(*)) + 1)) FROM ch)) * (1 + ln(n)))) AS v
  FROM qf LEFT JOIN idf USING (f) GROUP BY ALL),
cn AS (SELECT chunk_id, sum(v * v) AS s FROM cv GROUP BY chunk_id),
qn AS (SELECT item_id, sum(v * v) AS s FROM qv GROUP BY item_id),
dots AS (SELECT item_id, chunk_id, sum(qv.v * cv.v) AS dot FROM qv JOIN cv USING (d) GROUP BY ALL),
dist AS (
  SELECT b.item_id, ch.chunk_id, round(CASE WHEN cn.s * qn.s > 0 THEN 1 - coalesce(dot, 0) / (sqrt(qn.s) * sqrt(cn.s)) ELSE 1 END, {V.ROUND}) AS dist
  FROM benchmark b CROSS JOIN ch LEFT JOIN qn USING (item_id) LEFT JOIN cn USING (chunk_id) LEFT JOIN dots USING (item_id, chunk_id)),
hits AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dist, chunk_id) AS rank FROM dist)
SELECT item_id, string_agg(chunk_text || {sql_literal(V.CONTEXT_SEPARATOR)}, '' ORDER BY rank) AS context
FROM hits JOIN ch USING (chunk_id) WHERE rank <= 3 GROUP BY item_id""")
def phrase_context(t):
    """S3, V1-V7 in one: the context of every phrase over the stored index of all chunks."""
    phrases = t.benchmark.select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"))
    return R.retrieve(t.documents, phrases).withColumnRenamed("phrase_id", "item_id")


@query("s03_snapshot_edits", """
SELECT c_custkey, c_name, CASE WHEN c_custkey = 7 THEN 'moved' ELSE c_mktsegment END AS c_mktsegment, 3 AS version, true AS few_files
FROM customer WHERE NOT (c_custkey BETWEEN 20 AND 29 AND c_nationkey < 12)""")
def snapshot_edits(t):
    """Q7 on S3 snapshots: an update of one key, a delete in a range of keys, and the last version read back."""
    path = scratch_path(t.spark, "s03-snapshots")
    table = SnapshotTable(t.spark, path)
    table.save(t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), key="c_custkey")
    before = {f["path"] for f in table.manifest()["files"]}
    table.update(F.col("c_custkey") == 7, {"c_mktsegment": F.lit("moved")}, keys=(7, 7))
    after = {f["path"] for f in table.manifest()["files"]}
    version, _ = table.delete(F.col("c_nationkey") < 12, keys=(20, 29))
    out = cut_lineage(table.read().select("c_custkey", "c_name", "c_mktsegment", F.lit(version).alias("version"),
                                          F.lit(len(before - after) == 1).alias("few_files")))
    drop_scratch(path)
    return out


@query("q06_phrase_index", """
WITH p AS (SELECT item_id AS phrase_id, substr(text, 1, 9) AS phrase FROM benchmark)
SELECT phrase_id, doc_id FROM p JOIN documents ON contains(lower(text), lower(phrase))""")
def phrase_index(t):
    """Q6 by a stored gram index: every document that holds the first characters of a benchmark item, all items at once."""
    path = scratch_path(t.spark, "q06-index")
    index = PhraseIndex(t.spark, path, "lower")
    index.build(t.documents, "doc_id", "text")
    phrases = t.benchmark.select(F.col("item_id").alias("phrase_id"), F.substring("text", 1, 9).alias("phrase"))
    out = cut_lineage(index.search(phrases).select("phrase_id", F.col("id").alias("doc_id")))
    drop_scratch(path)
    return out
