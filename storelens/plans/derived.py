"""Stand-in inputs derived from the driver tables.

The reference works on logs the driver does not ship (activity, statements,
status lines, tool calls, access).  Each stand-in is derived row by row from
``events`` (or ``conversations``), so its size grows with the data.  Every
derivation is written once as SQL expressions that Spark (``selectExpr``)
and DuckDB both accept, so the Spark job and its oracle read identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from storelens.functions.text import sql_literal
from storelens.functions.times import epoch_us, epoch_us_sql

KIND_SQL = ("CASE event_type WHEN 'signup' THEN 'login_ok' WHEN 'error' THEN 'logout' "
            "ELSE 'chat' END")
K_SQL_SPARK = "CAST(get_json_object(props, '$.k') AS BIGINT)"
K_SQL_DUCK = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _k(df: DataFrame) -> DataFrame:
    return df.withColumn("k", F.expr(K_SQL_SPARK))


# ------------------------------------------------------------ activity log

def activity_log(events: DataFrame) -> DataFrame:
    """(session_id, ts_us, seq, kind): view/click/purchase are chats, signup a
    successful login, error a logout; seq is the event id."""
    return events.select(
        F.col("user_id").alias("session_id"),
        epoch_us("ts").alias("ts_us"),
        F.col("event_id").alias("seq"),
        F.expr(KIND_SQL).alias("kind"))


ACTIVITY_SQL = f"""activity AS (
  SELECT user_id AS session_id, epoch_us(ts) AS ts_us, event_id AS seq, {KIND_SQL} AS kind
  FROM events)"""


# A third of all activities on one id, within one time bucket of six hours.
HOT_ID_SQL = "CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END"
HOT_TS_SQL = "CASE WHEN event_id % 3 = 0 THEN 1704067200000000 + ts_us % 21600000000 ELSE ts_us END"


def hot_activity_log(events: DataFrame) -> DataFrame:
    """``activity_log`` with one very busy id."""
    plain = events.select("user_id", "event_id", epoch_us("ts").alias("ts_us"), F.expr(KIND_SQL).alias("kind"))
    return plain.selectExpr(f"{HOT_ID_SQL} AS session_id", f"{HOT_TS_SQL} AS ts_us", "event_id AS seq", "kind")


HOT_ACTIVITY_SQL = f"""activity AS (
  SELECT {HOT_ID_SQL} AS session_id, {HOT_TS_SQL} AS ts_us, event_id AS seq, kind
  FROM (SELECT *, epoch_us(ts) AS ts_us, {KIND_SQL} AS kind FROM (SELECT event_id, user_id, event_type, ts FROM events)))"""


# ------------------------------------------------------------ statement log

# Hand-made statements of FIXTURES.md section 3; {u} becomes the user id.
STATEMENTS = [
    "```sql\nSELECT * FROM orders WHERE o_custkey = {u}\n```",
    "```SQL\nSELECT {u}```",
    "select updated_at from t where id = {u}",
    "TRUNCATE t{u}",
    "dRoP table t{u}",
    "\t\n  SELECT c_name FROM customer WHERE c_custkey = {u};\n ",
    "",
]


def _statement_sql() -> str:
    whens = " ".join(f"WHEN {i} THEN {sql_literal(s)}" for i, s in enumerate(STATEMENTS))
    return (f"replace(CASE CAST(event_id % {len(STATEMENTS)} AS INT) {whens} END, "
            "'{u}', CAST(user_id AS STRING))")


STATEMENT_SQL = _statement_sql()
IS_ADMIN_SQL = "(event_id % 2 = 1)"


def statement_log(events: DataFrame) -> DataFrame:
    """(stmt_id, user_id, statement, is_admin)."""
    return events.selectExpr("event_id AS stmt_id", "user_id", f"{STATEMENT_SQL} AS statement",
                             f"{IS_ADMIN_SQL} AS is_admin")


STATEMENTS_CTE = f"""stmts AS (
  SELECT event_id AS stmt_id, user_id, {STATEMENT_SQL} AS statement, {IS_ADMIN_SQL} AS is_admin
  FROM events)"""


# ------------------------------------------------------------ tool calls

# The three helper tool names of the coordinator.
TOOL_DATABASE = "AgentBazyDanych"
TOOL_DOCUMENTS = "AgentPrzeszukaniaDokumentów"
TOOL_INTERNET = "AgentPrzeszukaniaInternetu"

CALL_KIND_SQL = "CASE WHEN event_type = 'error' THEN 'end' ELSE 'start' END"
CALL_NAME_SQL = (f"CASE event_type WHEN 'view' THEN '{TOOL_DATABASE}' "
                 f"WHEN 'click' THEN '{TOOL_DOCUMENTS}' WHEN 'purchase' THEN '{TOOL_INTERNET}' "
                 "WHEN 'signup' THEN 'other_tool' END")


def tool_calls(events: DataFrame) -> DataFrame:
    """(request_id, seq, ts_us, kind, tool_name)."""
    return events.select(
        F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"),
        epoch_us("ts").alias("ts_us"),
        F.expr(CALL_KIND_SQL).alias("kind"), F.expr(CALL_NAME_SQL).alias("tool_name"))


CALLS_CTE = f"""calls AS (
  SELECT user_id AS request_id, event_id AS seq, epoch_us(ts) AS ts_us,
         {CALL_KIND_SQL} AS kind, {CALL_NAME_SQL} AS tool_name
  FROM events)"""


# ------------------------------------------------------------ status lines

STATUS_NAMES = ["DATABASE", "RAG", "INTERNET", "THINKING", "NOT_A_STATUS"]
FINAL_TEMPLATES = [
    '{"type": "final", "data": "odpowiedz {k}"}',
    '{"type": "final", "data": "{\\"text\\": \\"w ciagu {k}\\"}"}',
    '{"type": "final", "data": {"text": "tekst {k}", "k": {k}}}',
    '{"type": "final", "data": {"text": "", "k": {k}}}',
    '{"type": "final", "data": [{"type": "text", "text": "lista {k}"}]}',
    '{"type": "final", "data": {"text": 0, "k": {k}}}',
    '{"type": "final", "data": {"text": false, "k": {k}}}',
    '{"type": "final", "data": {"text": null, "k": {k}}}',
]
ODD_LINES = ["", "{bad", '{"type": "final", "da', "null", "5", '{"type": "other", "data": 1}',
             '{"type": "final", "data": "ok {k}"} junk', '{"type": "final", "data": "a"}{"type": "error", "data": "b"}',
             '[{"type": "final", "data": "{k}"}]']


def _status_line_sql(k: str) -> str:
    """One JSON line per event in the server's format (json.dumps with its
    default separators), plus the malformed and odd lines a client meets.
    A CASE picks a short template; one replace fills in ``k``."""
    status = " ".join(f"WHEN {i} THEN {sql_literal('{\"type\": \"status\", \"data\": \"' + n + '\"}')}"
                      for i, n in enumerate(STATUS_NAMES))
    finals = " ".join(f"WHEN {i} THEN {sql_literal(x)}" for i, x in enumerate(FINAL_TEMPLATES))
    odd = " ".join(f"WHEN {i} THEN {sql_literal(x)}" for i, x in enumerate(ODD_LINES))
    template = f"""CASE
  WHEN event_type IN ('view', 'click') THEN CASE CAST({k} % 5 AS INT) {status} END
  WHEN event_type = 'purchase' THEN CASE CAST({k} % {len(FINAL_TEMPLATES)} AS INT) {finals} END
  WHEN event_type = 'error' THEN '{{"type": "error", "data": "Blad {{k}}"}}'
  ELSE CASE CAST({k} % {len(ODD_LINES)} AS INT) {odd} END
END"""
    return f"replace({template}, '{{k}}', CAST({k} AS STRING))"


def status_lines(events: DataFrame) -> DataFrame:
    """(request_id, seq, ts_us, line)."""
    # selectExpr: the same expression text is the DuckDB oracle's input
    return _k(events).selectExpr(
        "user_id AS request_id", "event_id AS seq",
        f"{epoch_us_sql('ts')} AS ts_us",
        f"{_status_line_sql('k')} AS line")


LINES_CTE = f"""lines AS (
  SELECT user_id AS request_id, event_id AS seq, epoch_us(ts) AS ts_us,
         {_status_line_sql('k')} AS line
  FROM (SELECT *, {K_SQL_DUCK} AS k FROM events))"""


# ------------------------------------------------------------ access log

ACCESS_FWD_SQL = """CASE event_type
  WHEN 'view' THEN NULL
  WHEN 'click' THEN ' 10.0.0.' || CAST(user_id % 8 AS STRING) || ' , 10.0.0.2'
  WHEN 'purchase' THEN '192.168.1.' || CAST(user_id % 20 AS STRING)
  WHEN 'signup' THEN chr(9) || '10.0.3.' || CAST(user_id % 5 AS STRING) || chr(10)
  ELSE '' END"""
ACCESS_PEER_SQL = "'10.0.' || CAST(user_id % 4 AS STRING) || '.' || CAST(user_id % 7 AS STRING)"
# Fixed allow-list used by the access stand-in (configuration, not data).
ALLOWED_ADDRESSES = ["10.0.0.1", "10.0.0.5", "192.168.1.15", "10.0.3.3", "10.0.1.1"]


def access_log(events: DataFrame) -> DataFrame:
    """(access_id, forwarded, peer)."""
    return events.selectExpr("event_id AS access_id", f"{ACCESS_FWD_SQL} AS forwarded",
                             f"{ACCESS_PEER_SQL} AS peer")


ACCESS_CTE = f"""access AS (
  SELECT event_id AS access_id, {ACCESS_FWD_SQL} AS forwarded, {ACCESS_PEER_SQL} AS peer
  FROM events)"""


# ------------------------------------------------------------ login attempts

ATTEMPT_CONFIGURED_SQL = "(k % 7 <> 0)"
ATTEMPT_OK_SQL = "CASE WHEN value < 2 THEN NULL ELSE k % 3 = 0 END"


def login_attempts(events: DataFrame) -> DataFrame:
    """(attempt_id, session_id, password_configured, check_ok); check_ok null = backend error."""
    return (_k(events).where("event_type = 'signup'")
            .selectExpr("event_id AS attempt_id", "user_id AS session_id",
                        f"{ATTEMPT_CONFIGURED_SQL} AS password_configured",
                        f"{ATTEMPT_OK_SQL} AS check_ok"))


LOGOUT_OK_SQL = "(event_id % 10 <> 3)"


def logout_attempts(events: DataFrame) -> DataFrame:
    """(attempt_id, session_id, ok); ok is false where the backend failed."""
    return events.where("event_type = 'error'").selectExpr("event_id AS attempt_id", "user_id AS session_id", f"{LOGOUT_OK_SQL} AS ok")


LOGOUTS_CTE = f"""logouts AS (
  SELECT event_id AS attempt_id, user_id AS session_id, {LOGOUT_OK_SQL} AS ok,
         user_id IN (SELECT session_id FROM activity WHERE kind = 'login_ok') AS known
  FROM events WHERE event_type = 'error')"""


ATTEMPTS_CTE = f"""attempts AS (
  SELECT event_id AS attempt_id, user_id AS session_id,
         {ATTEMPT_CONFIGURED_SQL} AS password_configured, {ATTEMPT_OK_SQL} AS check_ok
  FROM (SELECT *, {K_SQL_DUCK} AS k FROM events) WHERE event_type = 'signup')"""
