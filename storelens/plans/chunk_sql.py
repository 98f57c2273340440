"""The chunker's contract (``operators/chunking.py``) written out in DuckDB SQL.

One level per separator: a level cuts its segments before every occurrence of the first
separator that they hold, hands large pieces to the next level, and merges each run of
small neighbours by a recursion with one step per chunk.
"""

from __future__ import annotations

from storelens.functions.text import sql_literal
from storelens.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS


def chunk_ctes(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators=tuple(SEPARATORS)) -> str:
    """CTEs of a ``WITH RECURSIVE``; the last one is ``chunks(doc_id, chunk_no, s, e, chunk_text)``."""
    n = len(separators)
    steps = ["seg0 AS (SELECT doc_id, text, 0::BIGINT AS lo, length(text)::BIGINT AS hi, 0 AS f FROM documents WHERE length(text) > 0)"]
    done = []
    for level in range(n):
        which = " ".join(f"WHEN f <= {i} AND contains(body, {sql_literal(sep)}) THEN {i}" for i, sep in enumerate(separators))
        chars = " ".join(f"WHEN {i} THEN {sql_literal(sep)}" for i, sep in enumerate(separators))
        steps.append(f"""
at{level} AS MATERIALIZED (
  SELECT *, CASE w {chars} END AS sep FROM (
    SELECT *, CASE {which} END AS w FROM (SELECT *, substring(text, lo + 1, hi - lo) AS body FROM seg{level}))),
pc{level} AS MATERIALIZED (
  SELECT doc_id, text, lo, w, i, s, s + len AS e, len >= {size} AS large,
         sum((len >= {size})::INT) OVER (PARTITION BY doc_id, lo ORDER BY i) AS run
  FROM (SELECT *, lo + coalesce(sum(len) OVER (PARTITION BY doc_id, lo ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s
        FROM (SELECT doc_id, text, lo, w, i, (length(parts[i]) + CASE WHEN i > 1 THEN length(sep) ELSE 0 END)::BIGINT AS len
              FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, string_split(body, sep) AS parts FROM at{level} WHERE w IS NOT NULL))))
  WHERE len > 0),
m{level} AS (
  SELECT doc_id, lo, run, ss, es, 1::BIGINT AS k, len(list_filter(es, lambda x: x - ss[1] <= {size}))::BIGINT AS j
  FROM (SELECT doc_id, lo, run, list(s ORDER BY i) AS ss, list(e ORDER BY i) AS es FROM pc{level} WHERE NOT large GROUP BY doc_id, lo, run)
  UNION ALL
  SELECT doc_id, lo, run, ss, es, k2, len(list_filter(es, lambda x: x - ss[k2] <= {size}))::BIGINT
  FROM (SELECT *, 1 + len(list_filter(ss, lambda x: x < greatest(es[j] - {overlap}, es[j + 1] - {size})))::BIGINT AS k2 FROM m{level} WHERE j < len(es))),
seg{level + 1} AS (SELECT doc_id, text, s AS lo, e AS hi, w + 1 AS f FROM pc{level} WHERE large AND w < {n - 1})""")
        done += [f"SELECT doc_id, lo AS s, hi AS e FROM at{level} WHERE w IS NULL", f"SELECT doc_id, ss[k], es[j] FROM m{level}",
                 f"SELECT doc_id, s, e FROM pc{level} WHERE large AND w = {n - 1}"]
    done.append(f"SELECT doc_id, lo, hi FROM seg{n}")
    steps.append(f"""
chunks AS MATERIALIZED (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, e) - 1 AS chunk_no, s, e, substring(text, s + 1, e - s) AS chunk_text
  FROM ({' UNION ALL '.join(done)}) JOIN documents USING (doc_id))""")
    return ",\n".join(steps)


CHUNK_SQL = f"""
WITH RECURSIVE {chunk_ctes()}
SELECT doc_id, chunk_no, s AS start, e AS "end", chunk_text FROM chunks"""
