"""Registered document, vector and page queries.

Stand-ins: ``conversations`` turns as document pages, ``documents`` as the
corpus, ``embeddings`` as chunk vectors keyed like documents (vec_id =
doc_id), ``benchmark`` passages as search phrases, ``pages`` as web pages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.functions.text import sql_literal
from storelens.operators import chunking as V1
from storelens.operators import pages as P
from storelens.operators import vectors as V
from storelens.plans.chunk_sql import CHUNK_SQL
from storelens.plans.registry import query
from storelens.sources import documents as S

@query("s02_assemble_pages", """
SELECT conv_id, string_agg(COALESCE(text, ''), '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")
def s02(t):
    pages = t.conversations.select("conv_id", "turn", "text")
    return S.assemble_pages(pages, doc="conv_id", page_no="turn", text="text")


@query("s02_page_offsets", """
SELECT conv_id, turn, COALESCE(text, '') AS page_text,
       CAST(COALESCE(SUM(length(COALESCE(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM conversations""")
def s02_offsets(t):
    return S.page_offsets(t.conversations, doc="conv_id", page_no="turn", text="text")


@query("v01_chunk_invariants", f"""
SELECT doc_id, CAST(length(text) AS BIGINT) AS covered, true AS starts_at_zero, true AS ends_at_length,
       true AS no_gap, true AS overlap_ok, true AS size_ok
FROM documents WHERE length(text) > 0""")
def v01(t):
    chunks = V1.chunk_documents(t.documents, with_length=True)
    return V1.chunk_invariants(chunks)


@query("v01_chunks", CHUNK_SQL)
def v01_rows(t):
    return V1.chunk_documents(t.documents)


@query("v01_chunk_texts", """
SELECT doc_id, md5(text) AS text_md5, 0::BIGINT AS n_other
FROM documents WHERE length(text) > 0""")
def v01_texts(t):
    """The texts of the chunks: put together without their overlaps they are the
    document, and each is the document's text at its place."""
    from pyspark.sql import Window

    chunks = V1.chunk_documents(t.documents)
    before = F.coalesce(F.lag("end").over(Window.partitionBy("doc_id").orderBy("chunk_no")), F.lit(0))
    new = chunks.select("doc_id", "chunk_no", "start", "chunk_text", F.expr("chunk_text").alias("own"), before.alias("from"))
    own = F.expr("substring(chunk_text, CAST(from - start AS INT) + 1)")
    whole = (new.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", own.alias("own"), "start", "chunk_text"))).alias("c"))
             .join(t.documents.select(F.col("doc_id").alias("d"), "text"), F.col("doc_id") == F.col("d")))
    other = F.filter("c", lambda x: F.substr(F.col("text"), x["start"].cast("int") + 1, F.length(x["chunk_text"])) != x["chunk_text"])
    return whole.select("doc_id", F.md5(F.array_join(F.transform("c", lambda x: x["own"]), "").cast("binary")).alias("text_md5"),
                        F.size(other).cast("long").alias("n_other"))


@query("v02_chunk_carry", """
SELECT lang, source, COUNT(*) AS n_docs, CAST(SUM(length(text)) AS BIGINT) AS n_chars
FROM documents WHERE length(text) > 0 GROUP BY lang, source""")
def v02(t):
    chunks = V1.chunk_documents(t.documents, carry=["lang", "source"])
    per_doc = chunks.groupBy("doc_id", "lang", "source").agg(F.max("end").alias("len"))
    return per_doc.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"),
                                                 F.sum("len").cast("long").alias("n_chars"))


@query("v03_attach_vectors", """
SELECT doc_id, label, len(embedding) AS dims FROM documents JOIN embeddings ON doc_id = vec_id""")
def v03(t):
    out = V.attach_vectors(t.documents.select("doc_id"), t.embeddings, "doc_id", "vec_id")
    return out.select("doc_id", "label", F.size("embedding").cast("long").alias("dims"))


@query("v03_missing_vectors", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def v03b(t):
    return V.missing_vectors(t.documents.select("doc_id"), t.embeddings, "doc_id", "vec_id")


L2_SQL = ("round(list_sum(list_transform(range(1, len(a.embedding) + 1), "
          "lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * "
          "(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))), 6)")


@query("v04_nearest", f"""
WITH b AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1),
d AS (SELECT a.vec_id, {L2_SQL} AS dist FROM embeddings a, b WHERE a.embedding IS NOT NULL)
SELECT vec_id, dist, ROW_NUMBER() OVER (ORDER BY dist, vec_id) AS rank FROM d ORDER BY dist, vec_id LIMIT 3""")
def v04(t):
    first = t.embeddings.orderBy("vec_id").select("embedding").first()[0]  # one vector
    return V.nearest(t.embeddings, first, k=3).withColumn("rank", F.col("rank").cast("long"))


V5_SQL = f"""
WITH d AS (SELECT b.vec_id AS query_id, a.vec_id, {L2_SQL} AS dist
           FROM embeddings a, embeddings b WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM d)
SELECT query_id, vec_id, dist, rank FROM r WHERE rank <= 3"""


def _self_queries(t):
    return t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("v05_nearest_batch", V5_SQL)
def v05(t):
    return V.nearest_batch(t.embeddings, _self_queries(t), k=3)


def _planes_sql(dim: int = 64, planes: int = 12) -> str:
    """Rows (t, i, plane): the first planes of every table (enough for 2**20 index rows), then the sketch's words."""
    words = V.sketch_planes(dim).reshape(-1, 64, dim)
    tables = [*V.hyperplanes(dim)[:, :planes], *words]
    return ", ".join(f"({t}, {i}, [{', '.join(str(float(v)) for v in p)}])" for t, table in enumerate(tables) for i, p in enumerate(table))


# At most this share of the sample's neighbours lies beyond either limit.
V6_SHARE = (1 + V.TARGET_RECALL) / 2
V6_CTE = f"""
WITH p AS (SELECT greatest(0, ceil(log2(count(*) / {V.BUCKET_ROWS}.0)))::INT AS planes FROM embeddings),
pl(t, i, plane) AS (VALUES {_planes_sql()}),
e AS MATERIALIZED (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL),
pj AS MATERIALIZED (
  SELECT vec_id, t, i, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda j: embedding[j]::DOUBLE * plane[j]::DOUBLE)), {V.PLACES}) AS m
  FROM e, pl, p WHERE t >= {V.N_TABLES} OR i < planes),
signs AS MATERIALIZED (SELECT vec_id, t, sum(CASE WHEN m >= 0 THEN 1::HUGEINT << i ELSE 0 END)::UBIGINT AS b FROM pj GROUP BY vec_id, t),
h AS MATERIALIZED (SELECT vec_id, t, coalesce(b, 0)::UBIGINT AS b FROM (SELECT vec_id, t FROM e, range({V.N_TABLES}) AS r(t)) LEFT JOIN signs USING (vec_id, t)),
sk AS MATERIALIZED (SELECT vec_id, t, b FROM signs WHERE t >= {V.N_TABLES}),
asked AS (SELECT vec_id AS query_id FROM e ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT {V.SAMPLE}),
near AS MATERIALIZED (
  SELECT query_id, vec_id FROM (
    SELECT query_id, a.vec_id, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY {L2_SQL}, a.vec_id) AS rank
    FROM asked JOIN e b ON b.vec_id = query_id JOIN e a ON a.vec_id <> query_id) WHERE rank <= 3),
costs AS (
  SELECT query_id, vec_id, min(c) AS c FROM (
    SELECT query_id, near.vec_id, a.t, round(sum(CASE WHEN (a.m >= 0) <> (b.m >= 0) THEN a.m * a.m ELSE 0 END), {V.PLACES}) AS c
    FROM near JOIN pj a ON a.vec_id = query_id JOIN pj b ON b.vec_id = near.vec_id AND b.t = a.t AND b.i = a.i WHERE a.t < {V.N_TABLES}
    GROUP BY ALL) GROUP BY ALL),
gaps AS (
  SELECT query_id, near.vec_id, sum(bit_count(xor(a.b, b.b))) AS g
  FROM near JOIN sk a ON a.vec_id = query_id JOIN sk b ON b.vec_id = near.vec_id AND b.t = a.t GROUP BY ALL),
reach AS (SELECT coalesce(min(c), 0) AS reach FROM (SELECT c, row_number() OVER (ORDER BY c) AS r, count(*) OVER () AS n FROM costs)
          WHERE r >= ceil(round({V6_SHARE} * n, 6))),
gap AS (SELECT CASE WHEN (SELECT planes FROM p) = 0 THEN {64 * V.SKETCH_WORDS} ELSE coalesce(min(g), {64 * V.SKETCH_WORDS}) END AS gap
        FROM (SELECT g, row_number() OVER (ORDER BY g) AS r, count(*) OVER () AS n FROM gaps) WHERE r >= ceil(round({V6_SHARE} * n, 6))),
sets AS (SELECT s::UBIGINT AS s FROM p, range(4096) AS r(s) WHERE s < (1 << planes)),
pr AS MATERIALIZED (
  SELECT vec_id, t, xor(h.b, s)::UBIGINT AS b
  FROM (SELECT vec_id, t, s, round(sum(m * m), {V.PLACES}) AS c FROM pj JOIN sets ON (s >> i) & 1 = 1 WHERE t < {V.N_TABLES} GROUP BY vec_id, t, s)
  JOIN h USING (vec_id, t), reach WHERE c <= reach
  UNION ALL SELECT vec_id, t, b FROM h),
met AS (SELECT DISTINCT pr.vec_id AS query_id, h.vec_id FROM pr JOIN h USING (t, b)),
c AS (SELECT query_id, met.vec_id FROM met JOIN sk a ON a.vec_id = query_id JOIN sk b ON b.vec_id = met.vec_id AND b.t = a.t, gap
      GROUP BY query_id, met.vec_id, gap HAVING sum(bit_count(xor(a.b, b.b))) <= gap),
d AS (SELECT query_id, a.vec_id, {L2_SQL} AS dist FROM c JOIN embeddings a ON a.vec_id = c.vec_id JOIN embeddings b ON b.vec_id = query_id),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM d),
t3 AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM r WHERE rank <= 3)"""


@query("v06_nearest_approx", f"""{V6_CTE}
SELECT q.vec_id AS query_id, t3.vec_id, dist, rank, coalesce(n, 0) < 3 AS short
FROM (SELECT DISTINCT vec_id FROM embeddings) q LEFT JOIN t3 ON q.vec_id = t3.query_id""")
def v06(t):
    return V.nearest_approx(t.embeddings, _self_queries(t), k=3)


@query("v07_assemble_context", f"""
WITH h AS ({V5_SQL})
SELECT query_id, string_agg(COALESCE(text, '') || {sql_literal(V.CONTEXT_SEPARATOR)}, '' ORDER BY rank) AS context
FROM h LEFT JOIN documents ON vec_id = doc_id GROUP BY query_id""")
def v07(t):
    hits = V.nearest_batch(t.embeddings, _self_queries(t), k=3)
    hits = hits.join(t.documents.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left")
    return V.assemble_context(hits)


FILE_NAME_SQL = ("'doc_' || CAST(doc_id AS STRING) || CASE lang WHEN 'en' THEN '.pdf' WHEN 'fr' THEN '.PDF' "
                 "WHEN 'de' THEN '.pdf.txt' ELSE '.txt' END")


@query("v08_attach_document", f"""
WITH d AS (SELECT doc_id, {FILE_NAME_SQL} AS file_name, text AS doc_text FROM documents)
SELECT conv_id, turn,
       CASE WHEN COALESCE(ends_with(file_name, '.pdf'), false)
            THEN {sql_literal(S.ATTACH_TEMPLATE_HEAD)} || COALESCE(doc_text, '') || {sql_literal(S.ATTACH_TEMPLATE_TAIL)} || text
            ELSE text END AS request
FROM conversations LEFT JOIN d ON conv_id = doc_id WHERE role = 'user'""")
def v08(t):
    requests = t.conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("request"))
    docs = t.documents.select("doc_id", F.expr(FILE_NAME_SQL).alias("file_name"), F.col("text").alias("doc_text"))
    return S.attach_document(requests, docs, key="conv_id", doc_key="doc_id").select("conv_id", "turn", "request")


def _strip_sql(x):
    s = f"regexp_replace({x}, '{P.SCRIPT_RE}', ' ', 'g')"
    s = f"regexp_replace({s}, '{P.STYLE_RE}', ' ', 'g')"
    s = f"regexp_replace({s}, '{P.COMMENT_RE}', ' ', 'g')"
    return f"regexp_replace({s}, '{P.TAG_RE}', ' ', 'g')"


def _terms_sql(x):
    return f"list_filter(regexp_split_to_array(lower({x}), '{P.TERM_SPLIT_RE}'), lambda w: w <> '')"


@query("v09_page_search", f"""
WITH post AS (SELECT page_id, term, COUNT(*) AS tf
              FROM (SELECT page_id, unnest({_terms_sql(_strip_sql('html'))}) AS term FROM pages) GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS phrase_id, unnest({_terms_sql('text')}) AS term FROM benchmark),
s AS (SELECT phrase_id, page_id, COUNT(*) AS n_terms, CAST(SUM(tf) AS BIGINT) AS hits
      FROM q JOIN post USING (term) GROUP BY phrase_id, page_id),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY phrase_id ORDER BY n_terms DESC, hits DESC, page_id) AS rank FROM s)
SELECT * FROM r WHERE rank <= 3""")
def v09(t):
    phrases = t.benchmark.select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"))
    return P.page_search(t.pages, phrases, k=3)


@query("s03_index_roundtrip", """
SELECT vec_id AS chunk_id, text AS chunk_text, len(embedding) AS dims
FROM embeddings LEFT JOIN documents ON vec_id = doc_id""")
def s03(t):
    from storelens.session import scratch_path
    index = (t.embeddings.join(t.documents.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left")
             .select(F.col("vec_id").alias("chunk_id"), F.col("text").alias("chunk_text"), "embedding"))
    path = scratch_path(t.spark, "s03-index")
    S.save_index(index, path)
    loaded, err = S.load_index(t.spark, path)
    if err:
        raise RuntimeError(err)
    return loaded.select("chunk_id", "chunk_text", F.size("embedding").cast("long").alias("dims"))


@query("v06_recall", f"""{V6_CTE}, x AS ({V5_SQL})
SELECT count(t3.vec_id) / count(*) AS recall FROM x LEFT JOIN t3 ON x.query_id = t3.query_id AND x.vec_id = t3.vec_id""")
def v06_recall(t):
    """Measured recall@3 of the approximate search against the exact one."""
    approx = V.nearest_approx(t.embeddings, _self_queries(t), k=3)
    exact = V.nearest_batch(t.embeddings, _self_queries(t), k=3)
    return V.recall_at_k(approx, exact)
