"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm import common as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


@query("op2_histogram_shards")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes."""
    from storelens.llm.sharding import histogram_shards

    rows = histogram_shards(C.table(spark, sf_dir, "documents"), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g
  FROM (SELECT doc_id AS rid, * FROM w), range(1, len(ws) - 1) AS r(i)),
rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win), range(i, i + 3) AS q(p)
  WHERE c > 1 GROUP BY rid),
m AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id AS rid, * FROM w) LEFT JOIN rep USING (rid)),
f AS (
  SELECT *, (n_words < 50)::INT AS f1, (100 * n_repeat_words > 50 * n_words)::INT AS f2,
         (10 * n_symbols > n_words)::INT AS f3, (word_chars < 3 * n_words OR word_chars > 12 * n_words)::INT AS f4,
         (10 * n_dup_lines > 3 * n_lines)::INT AS f5 FROM m),
h AS (
  SELECT source, rule, sum(v) AS f, count(*) AS n
  FROM (SELECT source, unnest([1,2,3,4,5]) AS rule, unnest([f1,f2,f3,f4,f5]) AS v FROM f) GROUP BY ALL),
pr AS (
  SELECT rule, avg(f / n) AS m,
         least(greatest(CASE WHEN var_samp(f / n) > 0 THEN avg(f / n) * (1 - avg(f / n)) / var_samp(f / n) - 1 ELSE 1000.0 END, 1.0), 1000.0) AS k
  FROM h GROUP BY rule),
bad AS (SELECT source, bool_or((f + m * k) / (n + k) > 0.5) AS rejected FROM h JOIN pr USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (f1 = 1 OR f2 = 1) AS base_failed, (f1 = 0 AND f2 = 0 AND NOT rejected) AS kept
FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source
"""


@query("op3_host_quality_rules", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures of every document and the verdict of its host."""
    from storelens.llm.quality_rules import judge_hosts

    return judge_hosts(C.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*', 0, 's') ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, lower(split_part(rest, '/', 1)) AS host,
         CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END AS path FROM u),
o AS (
  SELECT page_id, host, path, split_part(host, '.', -1) AS suffix,
         CASE WHEN instr(host, '.') > 0 THEN split_part(host, '.', -2) || '.' || split_part(host, '.', -1) ELSE host END AS domain,
         quality AS good
  FROM p LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l
    ON l.doc_id = try_cast(regexp_extract(path, '^/[a-z]{2}/([0-9]{1,18})', 1) AS BIGINT)),
h AS (SELECT host, domain, suffix, coalesce(sum(good), 0) AS g, count(good) AS n FROM o GROUP BY ALL),
d AS (SELECT suffix, domain, sum(g) AS g, sum(n) AS n FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(g) AS g, sum(n) AS n FROM d GROUP BY ALL),
ks AS (SELECT coalesce(avg(g / n), 0.0) AS m, coalesce(least(greatest(CASE WHEN var_samp(g / n) > 0 THEN avg(g / n) * (1 - avg(g / n)) / var_samp(g / n) - 1 ELSE 1000.0 END, 1.0), 1000.0), 1000.0) AS k FROM s WHERE n > 0),
kd AS (SELECT coalesce(least(greatest(CASE WHEN var_samp(g / n) > 0 THEN avg(g / n) * (1 - avg(g / n)) / var_samp(g / n) - 1 ELSE 1000.0 END, 1.0), 1000.0), 1000.0) AS k FROM d WHERE n > 0),
kh AS (SELECT coalesce(least(greatest(CASE WHEN var_samp(g / n) > 0 THEN avg(g / n) * (1 - avg(g / n)) / var_samp(g / n) - 1 ELSE 1000.0 END, 1.0), 1000.0), 1000.0) AS k FROM h WHERE n > 0),
sr AS (SELECT suffix, (g + (SELECT m * k FROM ks)) / (n + (SELECT k FROM ks)) AS r FROM s),
dr AS (SELECT suffix, domain, (g + sr.r * (SELECT k FROM kd)) / (n + (SELECT k FROM kd)) AS r FROM d JOIN sr USING (suffix)),
hr AS (
  SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (t + 1)) AS bound
  FROM (SELECT host, n + (SELECT k FROM kh) AS t, (g + dr.r * (SELECT k FROM kh)) / (n + (SELECT k FROM kh)) AS mean
        FROM h JOIN dr USING (suffix, domain))),
r AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN bound < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN hr USING (host)
"""


@query("op4_host_reputation", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and reputation verdict of every page.

    A page's labelled outcome is the quality label of the document whose number
    its path carries (``/en/123``).
    """
    from storelens.llm.url_reputation import judge_urls, split_url

    pages = C.table(spark, sf_dir, "pages").select("page_id", "url")
    labels = C.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("good"))
    _, path = split_url(F.col("url"))
    shown = F.expr("try_cast(number AS bigint)")
    numbered = pages.select("page_id", F.regexp_extract(path, "^/[a-z]{2}/([0-9]{1,18})", 1).alias("number"))
    outcomes = numbered.select("page_id", shown.alias("doc_id")).join(labels, "doc_id").select("page_id", "good")
    return judge_urls(pages, outcomes)


@query("op1_order_minhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    from storelens.llm.order_minhash import near_duplicate_classes

    return near_duplicate_classes(C.table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS s FROM d, range(1, len(w) - 3) AS r(i)),
bs AS (SELECT DISTINCT id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS s FROM b, range(1, len(w) - 3) AS r(i)),
n AS (SELECT id, count(*) AS n FROM bs GROUP BY id),
x AS (SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item, n_shared FROM x JOIN n ON n.id = x.item_id WHERE 10 * n_shared >= 8 * n
"""


@query("op5_containment_search", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the shares that show it."""
    from storelens.llm.decontamination import contaminated

    return contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


@query("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the token files."""
    from storelens.llm.token_files import round_trip

    return round_trip(C.table(spark, sf_dir, "documents"))


@query("op7_suffix_repeats")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated bytes of every document, and a checksum of what is left."""
    from storelens.llm.repeated_spans import remove_repeats

    found = remove_repeats(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    from storelens.llm.toxicity import fit_on, score

    docs = C.table(spark, sf_dir, "documents")
    scored = score(docs, fit_on(docs, C.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (C.crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and its bytes decoded from them, as checksums."""
    import public_tokenizers

    from storelens.llm.byte_bpe import encode, load_ranks

    ranks = load_ranks(C.tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    found = encode(C.table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, carry=["doc_id"])
    return found.select("carried.doc_id", "n_tokens", F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_class_lm")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document under the class-based model, and the unigram base."""
    from storelens.llm.class_lm import held_out_fold, score_texts

    return score_texts(C.table(spark, sf_dir, "documents"), held_out_fold()).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_word_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document's words; a tenth of the documents, by hash of the id, gets a planted one."""
    from storelens.llm.periodic_runs import periodic_runs

    def bind(value, use):
        return F.transform(F.array(value), use)[0]

    def planted(words, n, a, g):
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    def told(words):
        n = F.size(words).cast("long")
        return F.when(n == 0, "").otherwise(planted(words, n, F.col("g") % n, F.col("g")))

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.regexp_extract_all("text", F.lit(f"({C.WORD_RE})"))
    found = periodic_runs(docs.select("doc_id", F.when(F.col("h") % 10 == 0, bind(words, told)).otherwise(F.col("text")).alias("text")), carry=["doc_id"])
    longest = F.expr("""array_sort(runs, (x, y) -> case when x.length != y.length then cast(sign(y.length - x.length) as int)
                                                       when x.start != y.start then cast(sign(x.start - y.start) as int)
                                                       else cast(sign(x.period - y.period) as int) end)[0]""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select(F.col("carried.doc_id").alias("doc_id"), "n_words", F.size("runs").cast("long").alias("n_runs"),
                        F.when(F.size("runs") > 0, longest).alias("r"), lines.alias("lines"), "collapsed").select(
        "doc_id", "n_runs", "r.start", "r.length", "r.period", F.expr("1000 * r.length div r.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")


@query("op12_tier_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its window."""
    from storelens.llm.tier_packing import pack_documents

    return pack_documents(C.table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step_id")


def _op13_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024) -> str:
    """Lloyd's rounds written out, in whole numbers of any size that DuckDB has."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale}.0::DOUBLE * x::DOUBLE)::HUGEINT) AS xs
  FROM embeddings WHERE len(embedding) = {dims} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
x AS MATERIALIZED (SELECT rid, unnest(generate_series(1, {dims})) AS d, unnest(xs) AS x FROM v),
c0 AS MATERIALIZED (
  SELECT c, unnest(generate_series(1, {dims})) AS d, unnest(xs) AS x
  FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), xs) - 1 AS c, xs FROM v) WHERE c < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, arg_min(c, (s, c)) AS c, min(s) AS s
  FROM (SELECT rid, c, sum((x.x - c{r}.x) * (x.x - c{r}.x)) AS s FROM x JOIN c{r} USING (d) GROUP BY rid, c) GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT c, d, sum(x)::HUGEINT AS t, count(*)::HUGEINT AS n FROM x JOIN a{r} USING (rid) GROUP BY c, d),
c{r + 1} AS MATERIALIZED (
  SELECT c, d, CASE WHEN n IS NULL THEN x WHEN t >= 0 THEN t // n ELSE -((n - 1 - t) // n) END AS x FROM c{r} LEFT JOIN m{r} USING (c, d))""")
    return f"""
WITH {",".join(steps)},
i AS (SELECT c, sum(s) AS own, sum(sum(s)) OVER () AS everything FROM a{rounds} GROUP BY c),
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS sha FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, s::BIGINT AS distance, own::BIGINT AS cluster_inertia, everything::BIGINT AS inertia, sha AS centroid_sha256
FROM v JOIN a{rounds} USING (rid) JOIN i USING (c) JOIN h USING (c)
"""


@query("op13_dimension_kmeans", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every usable vector after ten rounds."""
    from storelens.llm.sharded_kmeans import cluster, with_inertia

    return with_inertia(*cluster(C.table(spark, sf_dir, "embeddings")))
