"""Registered statement-policy (Q), session (C) and status (N, S4/S5) queries.

Inputs are the stand-in logs of :mod:`storelens.plans.derived`, derived from
``events`` and ``conversations`` row by row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.functions.text import PY_WHITESPACE, sql_literal
from storelens.operators import sessions as C
from storelens.operators import sqlpolicy as Q
from storelens.operators import status as N
from storelens.plans import derived as D
from storelens.plans.registry import query

NOW_US = 1_705_708_800_000_000  # 2024-01-20 00:00:00 UTC
TTL = C.SESSION_TTL_S * C.US
SWEEP = C.SWEEP_S * C.US
WS = sql_literal(PY_WHITESPACE)

# ------------------------------------------------------------------ Q1-Q7

CLEAN_SQL = f"trim(replace(replace(statement, '```sql', ''), '```', ''), {WS})"
WRITE_SQL = " OR ".join(f"contains(upper(clean_sql), '{w}')" for w in Q.WRITE_WORDS)


@query("q01_clean_statement", f"""
WITH {D.STATEMENTS_CTE}
SELECT stmt_id, {CLEAN_SQL} AS clean_sql FROM stmts""")
def q01(t):
    log = D.statement_log(t.events)
    return log.select("stmt_id", Q.clean_statement("statement").alias("clean_sql"))


@query("q02_write_words", f"""
WITH {D.STATEMENTS_CTE}, c AS (SELECT stmt_id, {CLEAN_SQL} AS clean_sql FROM stmts)
SELECT stmt_id, ({WRITE_SQL}) AS is_write,
       array_to_string(list_filter([{", ".join(f"CASE WHEN contains(upper(clean_sql), '{w}') THEN '{w}' END" for w in Q.WRITE_WORDS)}], lambda x: x IS NOT NULL), ',') AS words
FROM c""")
def q02(t):
    log = D.statement_log(t.events).select("stmt_id", Q.clean_statement("statement").alias("clean_sql"))
    return log.select("stmt_id", Q.is_write("clean_sql").alias("is_write"),
                      F.array_join(Q.write_words("clean_sql"), ",").alias("words"))


@query("q03_policy_decision", f"""
WITH {D.STATEMENTS_CTE}, c AS (SELECT *, {CLEAN_SQL} AS clean_sql FROM stmts),
w AS (SELECT *, ({WRITE_SQL}) AS is_write FROM c)
SELECT stmt_id, is_admin, clean_sql, is_write,
       CASE WHEN NOT is_admin AND is_write THEN 'refused' WHEN is_write THEN 'commit' ELSE 'rows' END AS action,
       CASE WHEN NOT is_admin AND is_write THEN NULL WHEN is_admin THEN 'root' ELSE 'customer' END AS login,
       (is_admin AND is_write AND (substr(upper(clean_sql), 1, 6) = 'SELECT' OR substr(upper(clean_sql), 1, 4) = 'WITH'))
         AS admin_read_as_write
FROM w""")
def q03(t):
    log = D.statement_log(t.events)
    return Q.decide(log).select("stmt_id", "is_admin", "clean_sql", "is_write", "action", "login",
                                "admin_read_as_write")


Q4_STATEMENT = """```sql
SELECT o_orderpriority, COUNT(*) AS n_orders, MAX(o_totalprice) AS max_total
FROM orders GROUP BY o_orderpriority;
```"""


@query("q04_run_read", """
SELECT o_orderpriority, COUNT(*) AS n_orders, MAX(o_totalprice) AS max_total
FROM orders GROUP BY o_orderpriority""")
def q04(t):
    outcome, df, message = Q.run_read(t.spark, Q4_STATEMENT, {"orders": t.orders}, is_admin=False)
    if df is None:
        raise RuntimeError(message)
    return df


@query("q05_top_n", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def q05(t):
    return Q.top_n(t.orders.select("o_orderkey", "o_totalprice"),
                   [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10)


@query("q06_phrase_collation", """
SELECT doc_id FROM documents WHERE contains(strip_accents(lower(text)), 'ele')""")
def q06a(t):
    return Q.phrase_filter(t.documents, "text", "ele", "collation").select("doc_id")


@query("q06_phrase_lower", """
SELECT doc_id FROM documents WHERE contains(lower(text), 'éle')""")
def q06b(t):
    return Q.phrase_filter(t.documents, "text", "éle", "lower").select("doc_id")


@query("q06_phrase_exact", """
SELECT doc_id FROM documents WHERE contains(text, 'the')""")
def q06c(t):
    return Q.phrase_filter(t.documents, "text", "the", "exact").select("doc_id")


@query("q07_update_where", """
SELECT o_orderkey, CASE WHEN COALESCE(o_totalprice > 400000, false) THEN '1-URGENT' ELSE o_orderpriority END
       AS o_orderpriority
FROM orders""")
def q07a(t):
    out, _ = Q.update_where(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"),
                            F.col("o_totalprice") > 400000, {"o_orderpriority": F.lit("1-URGENT")})
    return out.select("o_orderkey", "o_orderpriority")


@query("q07_update_count", """
SELECT 'modified' AS outcome, COUNT(*) AS affected_rows FROM orders
WHERE o_totalprice > 400000 AND o_orderpriority IS DISTINCT FROM '1-URGENT'""")
def q07b(t):
    _, n = Q.update_where(t.orders, F.col("o_totalprice") > 400000, {"o_orderpriority": F.lit("1-URGENT")})
    return n


@query("q07_delete_count", """
SELECT 'modified' AS outcome, COUNT(*) AS affected_rows FROM orders WHERE COALESCE(o_orderstatus = 'P', false)""")
def q07e(t):
    return Q.delete_where(t.orders, F.col("o_orderstatus") == "P")[1]


@query("q07_insert_count", """
SELECT 'modified' AS outcome, COUNT(*) AS affected_rows FROM orders WHERE o_orderstatus = 'P'""")
def q07f(t):
    return Q.insert_rows(t.orders, t.orders.where("o_orderstatus = 'P'"))[1]


@query("q07_delete_where", """
SELECT o_orderkey FROM orders WHERE NOT COALESCE(o_orderstatus = 'P', false)""")
def q07c(t):
    out, _ = Q.delete_where(t.orders, F.col("o_orderstatus") == "P")
    return out.select("o_orderkey")


@query("q07_insert_rows", """
SELECT o_orderkey, o_custkey FROM orders
UNION ALL SELECT o_orderkey + 100000000, o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def q07d(t):
    base = t.orders.select("o_orderkey", "o_custkey")
    new = t.orders.where("o_orderstatus = 'P'").select(
        (F.col("o_orderkey") + 100_000_000).alias("o_orderkey"), "o_custkey")
    out, _ = Q.insert_rows(base, new)
    return out


# ------------------------------------------------------------------ C1-C13

@query("c01_session_table", f"""
WITH {D.ACTIVITY_SQL}
SELECT session_id, MIN(ts_us) AS first_us, MAX(ts_us) AS last_us, COUNT(*) AS n_activities
FROM activity WHERE kind IN ('chat', 'login_ok') GROUP BY session_id""")
def c01(t):
    return C.session_table(D.activity_log(t.events))


@query("c02_expired_at", f"""
WITH {D.ACTIVITY_SQL}
SELECT session_id, MAX(ts_us) AS last_us FROM activity WHERE kind IN ('chat', 'login_ok') AND ts_us <= {NOW_US}
GROUP BY session_id HAVING {NOW_US} - MAX(ts_us) > {TTL}""")
def c02(t):
    """What a sweep at NOW finds expired in the log up to then."""
    log = D.activity_log(t.events).where(F.col("ts_us") <= NOW_US)
    return C.expired_at(C.session_table(log), NOW_US).select("session_id", "last_us")


def _sessionize_sql(kinds, new_rule):
    kinds_sql = ", ".join(f"'{k}'" for k in kinds)
    return f"""
WITH {D.ACTIVITY_SQL},
l AS (SELECT session_id, ts_us, seq, kind,
             LAG(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us, seq) AS prev_us
      FROM activity WHERE kind IN ({kinds_sql}))
SELECT session_id, ts_us, seq, kind, prev_us,
       CAST(SUM(CASE WHEN prev_us IS NULL OR {new_rule} THEN 1 ELSE 0 END)
            OVER (PARTITION BY session_id ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no
FROM l"""


SWEEP_RULE = f"ts_us >= {SWEEP} * ((prev_us + {TTL}) // {SWEEP} + 1)"
C4_SQL = _sessionize_sql(C.ACTIVITY_KINDS, SWEEP_RULE)


@query("c03_sessionize_client", _sessionize_sql(("chat",), f"ts_us - prev_us > {TTL}"))
def c03(t):
    return C.sessionize(D.activity_log(t.events))


@query("c04_sessionize_swept", C4_SQL)
def c04(t):
    return C.sessionize_swept(D.activity_log(t.events))


@query("c05_sweep_counts", f"""
WITH s AS ({C4_SQL})
SELECT removed_us, COUNT(*) AS n_removed FROM (
  SELECT session_id, session_no, {SWEEP} * ((MAX(ts_us) + {TTL}) // {SWEEP} + 1) AS removed_us
  FROM s GROUP BY session_id, session_no)
GROUP BY removed_us""")
def c05(t):
    return C.sweep_counts(C.sessionize_swept(D.activity_log(t.events)))


C8_SQL = f"""
WITH s AS ({C4_SQL}), {D.ACTIVITY_SQL},
b AS (SELECT session_id, ts_us, seq, kind, session_no FROM s
      UNION ALL SELECT session_id, ts_us, seq, kind, NULL FROM activity WHERE kind = 'logout'),
a AS (SELECT *, last_value(session_no IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts_us, seq
                ROWS UNBOUNDED PRECEDING) AS sess FROM b),
f AS (SELECT *, CASE kind WHEN 'login_ok' THEN true WHEN 'logout' THEN false END AS flag
      FROM a WHERE sess IS NOT NULL),
r AS (SELECT *, COALESCE(last_value(flag IGNORE NULLS) OVER (PARTITION BY session_id, sess
                ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING), false) AS is_admin FROM f)
SELECT session_id, seq, ts_us, sess AS session_no, is_admin FROM r WHERE kind = 'chat'"""


@query("c08_role_as_of", C8_SQL)
def c08(t):
    return C.role_as_of(D.activity_log(t.events))


HOT_ROWS = 4096


@query("c04_hot_id", C4_SQL.replace(D.ACTIVITY_SQL, D.HOT_ACTIVITY_SQL))
def c04_hot(t):
    """C4 where a third of all rows is one id within six hours: windows by rank, none longer than about HOT_ROWS."""
    return C.sessionize_swept(D.hot_activity_log(t.events), bucket_rows=HOT_ROWS)


@query("c08_hot_id", C8_SQL.replace(D.ACTIVITY_SQL, D.HOT_ACTIVITY_SQL))
def c08_hot(t):
    return C.role_as_of(D.hot_activity_log(t.events), bucket_rows=HOT_ROWS)


@query("c09_history_before", """
SELECT conv_id, turn, COUNT(*) OVER w AS n_before,
       COALESCE(array_to_string(list(role || ': ' || text) OVER w, chr(10)), '') AS history_text
FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def c09(t):
    h = C.history_before(t.conversations)
    return h.select("conv_id", "turn", F.col("n_before").cast("long").alias("n_before"), "history_text")


HISTORY_LAST_N = 3


@query("c09_history_last_n", f"""
SELECT conv_id, turn, COUNT(*) OVER w AS n_before,
       COALESCE(array_to_string(list(role || ': ' || text) OVER w, chr(10)), '') AS history_text
FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {HISTORY_LAST_N} PRECEDING AND 1 PRECEDING)""")
def c09_last_n(t):
    """C9 with the bounded history option (no conversation whole in one task)."""
    h = C.history_before(t.conversations, last_n=HISTORY_LAST_N)
    return h.select("conv_id", "turn", F.col("n_before").cast("long").alias("n_before"), "history_text")


@query("c10_transcript", """
SELECT conv_id, COUNT(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript_text
FROM conversations GROUP BY conv_id""")
def c10(t):
    tr = C.transcript(t.conversations)
    return tr.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "transcript_text")


@query("c10_transcript_rows", """
SELECT conv_id, turn, role || ': ' || text AS line,
       CAST(COALESCE(SUM(length(role || ': ' || text) + 1) OVER (PARTITION BY conv_id ORDER BY turn
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM conversations""")
def c10_rows(t):
    return C.transcript_rows(t.conversations)


@query("c11_prefix_request", f"""
SELECT conv_id, turn,
       CASE WHEN conv_id % 2 = 1 THEN {sql_literal(C.ADMIN_EXTENSION)} || chr(10) || {sql_literal(C.ADMIN_REQUEST_PREFIX)} || text
            ELSE {sql_literal(C.GUEST_EXTENSION)} || chr(10) || text END AS request
FROM conversations WHERE role = 'user'""")
def c11(t):
    turns = t.conversations.where(F.col("role") == "user")
    return turns.select("conv_id", "turn",
                        C.prefix_request("text", F.col("conv_id") % 2 == 1).alias("request"))


@query("c12_admin_allowed", f"""
WITH {D.ACCESS_CTE}, a AS (SELECT *, trim(split_part(COALESCE(forwarded, peer), ',', 1), {WS}) AS client_ip FROM access)
SELECT access_id, forwarded, peer, client_ip,
       client_ip IN ({", ".join(f"'{a}'" for a in D.ALLOWED_ADDRESSES)}) AS is_admin_control_allowed
FROM a""")
def c12(t):
    allowed = t.spark.createDataFrame([(a,) for a in D.ALLOWED_ADDRESSES], "address string")
    return C.admin_allowed(D.access_log(t.events), allowed)


@query("c13_logout_summary", f"""
WITH {D.ACTIVITY_SQL}, {D.LOGOUTS_CTE}
SELECT CASE WHEN NOT ok THEN 'error' ELSE 'correct' END AS status,
       CASE WHEN NOT ok THEN 'Błąd backendu' ELSE 'Wylogowano admina' END AS message, COUNT(*) AS n_attempts
FROM logouts WHERE known OR NOT ok GROUP BY ALL""")
def c13b(t):
    log = D.activity_log(t.events)
    known = log.where("kind = 'login_ok'").select("session_id").distinct()
    return C.logout_summary(D.logout_attempts(t.events), known)


@query("c13_login_summary", f"""
WITH {D.ATTEMPTS_CTE},
o AS (SELECT CASE WHEN NOT COALESCE(password_configured, false) THEN 'error' WHEN check_ok IS NULL THEN 'error'
                  WHEN check_ok THEN 'correct' ELSE 'error' END AS status,
             CASE WHEN NOT COALESCE(password_configured, false) THEN 'Brak hasła'
                  WHEN check_ok IS NULL THEN 'Błąd backendu'
                  WHEN check_ok THEN 'Zalogowano na admina' ELSE 'loginErr4r' END AS message
      FROM attempts)
SELECT status, message, COUNT(*) AS n_attempts FROM o GROUP BY status, message""")
def c13(t):
    return C.login_summary(D.login_attempts(t.events))


# ------------------------------------------------------------------ S4, S5, N1-N7

KIND_DUCK = """CASE WHEN NOT json_valid({x}) THEN NULL
  WHEN json_type({x}) = 'OBJECT' THEN 'object' WHEN json_type({x}) = 'ARRAY' THEN 'array'
  WHEN json_type({x}) = 'VARCHAR' THEN 'string' WHEN json_type({x}) = 'NULL' THEN 'null' ELSE 'other' END"""
DATA_KIND_DUCK = """CASE WHEN NOT json_valid(line) OR json_type(line) <> 'OBJECT' THEN NULL
  WHEN json_type(line, '$.data') IS NULL THEN NULL
  WHEN json_type(line, '$.data') = 'OBJECT' THEN 'object' WHEN json_type(line, '$.data') = 'ARRAY' THEN 'array'
  WHEN json_type(line, '$.data') = 'VARCHAR' THEN 'string' WHEN json_type(line, '$.data') = 'NULL' THEN 'null'
  ELSE 'other' END"""
PARSED_CTE = f"""parsed AS (
  SELECT request_id, seq, ts_us, line, {KIND_DUCK.format(x='line')} AS line_kind,
         CASE WHEN json_valid(line) AND json_type(line) = 'OBJECT' THEN json_extract_string(line, '$.type') END AS type,
         CASE WHEN json_valid(line) THEN json_extract_string(line, '$.data') END AS data,
         {DATA_KIND_DUCK} AS data_kind
  FROM lines)"""


# an object's text, where it is truthy: not null, "", 0 or false
TRUTHY_TEXT_DUCK = """CASE WHEN data_kind = 'object' AND json_type(line, '$.data.text') IS DISTINCT FROM 'NULL'
  AND json_extract_string(line, '$.data.text') NOT IN ('', '0', 'false') THEN json_extract_string(line, '$.data.text') END"""


@query("s04_parse_status_lines", f"""
WITH {D.LINES_CTE}, {PARSED_CTE}
SELECT request_id, seq, type, data, data_kind FROM parsed WHERE type IN ('status', 'final', 'error')""")
def s04(t):
    parsed = N.parse_status_lines(D.status_lines(t.events))
    return parsed.select("request_id", "seq", "type", "data", "data_kind")


@query("s05_to_status_lines", """
SELECT event_id AS seq, 'status' AS type, event_type AS data FROM events""")
def s05(t):
    rows = t.events.select(F.col("event_id").alias("seq"), F.lit("status").alias("type"),
                           F.col("event_type").alias("data"))
    lines = N.to_status_lines(rows).select("seq", "line")
    # checked parse-equal: re-read the written lines
    back = N.parse_status_lines(lines)
    return back.select("seq", "type", "data")


N1_SQL = f"""
WITH {D.CALLS_CTE}
SELECT request_id, seq, ts_us, kind, tool_name, status FROM (
  SELECT *, CASE WHEN kind = 'end' THEN 'THINKING' WHEN kind = 'start' THEN
    CASE tool_name {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.TOOL_STATUS.items())} END END AS status
  FROM calls) WHERE status IS NOT NULL"""


@query("n01_tool_status", N1_SQL)
def n01(t):
    return N.tool_status(D.tool_calls(t.events))


@query("n02_latest_status", f"""
WITH st AS ({N1_SQL}),
last AS (SELECT request_id, arg_max(status, seq) AS s FROM st GROUP BY request_id)
SELECT r.request_id, COALESCE(s, 'THINKING') AS status
FROM (SELECT DISTINCT user_id AS request_id FROM events) r LEFT JOIN last USING (request_id)""")
def n02(t):
    requests = t.events.select(F.col("user_id").alias("request_id"))
    return N.latest_status(requests, N.tool_status(D.tool_calls(t.events)))


@query("n03_status_spans", f"""
WITH st AS ({N1_SQL}),
s AS (SELECT *, LEAD(ts_us) OVER (PARTITION BY request_id ORDER BY ts_us, seq) AS nxt FROM st)
SELECT request_id, status, COUNT(*) AS n_entries, CAST(SUM(nxt - ts_us) AS BIGINT) AS time_us
FROM s GROUP BY request_id, status""")
def n03(t):
    return N.status_spans(N.tool_status(D.tool_calls(t.events)))


@query("n04_final_reply", f"""
WITH {D.LINES_CTE}, {PARSED_CTE},
p AS (SELECT *, (type = 'error' OR line_kind = 'null') AS abort,
             {TRUTHY_TEXT_DUCK} AS txt FROM parsed),
g AS (SELECT request_id, MIN(seq) FILTER (WHERE abort) AS first_err,
             arg_min_null(data, seq) FILTER (WHERE abort) AS err,
             arg_max_null(data, seq) FILTER (WHERE type = 'final') AS fdata,
             arg_max_null(data_kind, seq) FILTER (WHERE type = 'final') AS fkind,
             arg_max_null(txt, seq) FILTER (WHERE type = 'final') AS ftxt,
             COUNT(*) FILTER (WHERE type = 'final') AS nfin
      FROM p GROUP BY request_id)
SELECT request_id,
       CASE WHEN first_err IS NOT NULL THEN 'error' WHEN nfin > 0 THEN 'final' ELSE 'empty' END AS outcome,
       CASE WHEN first_err IS NOT NULL THEN err
            WHEN nfin > 0 THEN CASE WHEN fkind = 'object' AND COALESCE(ftxt, '') <> '' THEN ftxt ELSE fdata END
            ELSE '' END AS reply
FROM g""")
def n04(t):
    return N.final_reply(D.status_lines(t.events))


@query("n06_status_label", f"""
WITH {D.LINES_CTE}, {PARSED_CTE},
labels(st, label) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in N.STATUS_LABELS.items())})
SELECT request_id, seq, data AS status, COALESCE(label, '{N.STATUS_LABELS[N.THINKING]}') AS label
FROM parsed LEFT JOIN labels ON data = st WHERE type = 'status'""")
def n06(t):
    st = N.parse_status_lines(D.status_lines(t.events)).where(F.col("type") == "status") \
        .select("request_id", "seq", F.col("data").alias("status"))
    return N.status_label(st)


RESPONSE_SQL = f"""CASE WHEN action = 'refused' THEN '{Q.MSG_REFUSED}'
  WHEN action = 'commit' THEN 'Dokonano modyfikacji ' || CAST(user_id % 4 AS STRING) || ' wierszy'
  WHEN substr(upper(clean_sql), 1, 6) = 'SELECT' THEN 'Dane z bazy: [' || CAST(user_id AS STRING) || ']'
  WHEN clean_sql = '' THEN 'BŁĄD MySQL: Query was empty | Próbowano wykonać: '
  ELSE 'Wykonano zapytanie: ' || clean_sql || ', ale baza jest pusta lub nic nie pasuje.' END"""


@query("n07_outcome_counts", f"""
WITH {D.STATEMENTS_CTE}, c AS (SELECT *, {CLEAN_SQL} AS clean_sql FROM stmts),
w AS (SELECT *, ({WRITE_SQL}) AS is_write FROM c),
d AS (SELECT *, CASE WHEN NOT is_admin AND is_write THEN 'refused' WHEN is_write THEN 'commit' ELSE 'rows' END AS action FROM w),
r AS (SELECT {RESPONSE_SQL} AS response FROM d)
SELECT CASE {" ".join(f"WHEN substr(response, 1, {len(p)}) = {sql_literal(p)} THEN '{h}'" for h, o, p in N.OUTCOME_PREFIXES)} ELSE 'other' END AS helper,
       CASE {" ".join(f"WHEN substr(response, 1, {len(p)}) = {sql_literal(p)} THEN '{o}'" for h, o, p in N.OUTCOME_PREFIXES)} ELSE 'answer' END AS outcome,
       COUNT(*) AS n_responses
FROM r GROUP BY 1, 2""")
def n07(t):
    decided = Q.decide(D.statement_log(t.events))
    responses = decided.select(F.expr(RESPONSE_SQL).alias("response"))
    return N.outcome_counts(responses)


@query("n05_reply_text", f"""
WITH {D.LINES_CTE}, {PARSED_CTE}
SELECT request_id, seq, data_kind,
       COALESCE({TRUTHY_TEXT_DUCK}, data) AS reply
FROM parsed WHERE type = 'final'""")
def n05(t):
    parsed = N.parse_status_lines(D.status_lines(t.events)).where(F.col("type") == "final")
    return parsed.select("request_id", "seq", "data_kind",
                         N.reply_text(F.col("data"), F.col("data_kind"), F.col("text")).alias("reply"))
