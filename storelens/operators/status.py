"""Status streams: S4/S5 line codec and N1-N7 reductions.

A request's reply arrives as JSON lines ``{"type", "data"}`` with type
status, final or error.  A line counts only when it is exactly one JSON value, as
for the client's ``JSON.parse``; Spark's own JSON readers stop after the first
value, so lines are parsed by a Pandas UDF, once per line.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from storelens.functions import windows as W
from storelens.functions.text import col_of

# Fixed values from the reference: status names, tool-name mapping, UI labels.
THINKING = "THINKING"
TOOL_STATUS = {
    "AgentBazyDanych": "DATABASE",
    "AgentPrzeszukaniaDokumentów": "RAG",
    "AgentPrzeszukaniaInternetu": "INTERNET",
}
STATUS_LABELS = {
    "THINKING": "Myślę",
    "DATABASE": "Sprawdzam w bazie",
    "RAG": "Przeszukuję dokumenty",
    "INTERNET": "Szukam w Internecie",
}
KNOWN_TYPES = ["status", "final", "error"]

# Reply texts of the helpers, by outcome class (prefix match).
OUTCOME_PREFIXES = [
    ("database", "refused", "Odmowa dostępu. Niedozwolone polecenie"),
    ("database", "modified", "Dokonano modyfikacji "),
    ("database", "empty", "Wykonano zapytanie: "),
    ("database", "rows", "Dane z bazy: "),
    ("database", "error", "BŁĄD MySQL: "),
    ("database", "error", "Błąd systemu: Błąd agenta bazy danych"),
    ("documents", "error", "Błąd backendu. Baza wektorowa niezdefiniowana"),
    ("documents", "error", "Błąd przeszukiwania dokumentów: "),
    ("documents", "error", "Błąd komunikacji z agentem RAG: "),
    ("internet", "error", "Błąd systemu: Błąd agenta Intenernetu"),
    ("coordinator", "error", "Błąd systemu: Koordynator ma problem"),
    ("server", "error", "Error "),
]


# ------------------------------------------------------------------ S4, S5

PARSED = "type string, is_null_line boolean, data string, data_kind string, text string"


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


_LONE = re.compile("[\ud800-\udfff]")


def _js(value) -> str | None:
    """A value's text: strings as they are, null as null, else compact JSON with
    whole floats written as integers.  Half a surrogate pair, which no column can hold,
    is U+FFFD in a string and its escape in JSON, as the client has it."""
    if value is None:
        return value
    if isinstance(value, str):
        return _LONE.sub("\ufffd", value)
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, ensure_ascii=False, separators=(",", ":")))


def _number(text: str):
    """A number as the client writes it back: one beyond a double's range is infinite there, and null in JSON."""
    value = float(text)
    if math.isinf(value):
        return None
    return int(value) if value.is_integer() and abs(value) < 1e21 else value


def _parse_line(line: str | None):
    """(type, is_null_line, data, data_kind, text) of one line; all null when it is
    not exactly one JSON value (the client's ``JSON.parse`` throws, and the line is ignored).

    Repeated keys: the last one counts.  ``text`` is an object's ``text``
    when it is truthy (not null, "", 0 or false).
    """
    try:
        value = json.loads(line, parse_constant=_no_constant, parse_float=_number)
    except (ValueError, TypeError, RecursionError):
        return None, False, None, None, None
    if not isinstance(value, dict):
        return None, value is None, None, None, None
    kind = value.get("type")
    if "data" not in value:
        return _js(kind), False, None, None, None
    data = value["data"]
    name = {dict: "object", list: "array", str: "string", type(None): "null"}.get(type(data), "other")
    text = data.get("text") if isinstance(data, dict) else None
    return _js(kind), False, _js(data), name, _js(text) if text else None  # a text of 1e400 counts as null


def _parse(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_parse_line(x) for x in lines], columns=["type", "is_null_line", "data", "data_kind", "text"])


def parse_lines(lines: DataFrame, line: str = "line", terminated: str | None = None) -> DataFrame:
    """Every line with its parse: ``type`` (of an object line), ``is_null_line``
    (the line is JSON ``null``), ``data`` as text, ``data_kind`` ('object', 'array',
    'string', 'null', 'other'), and ``text``, the object's truthy ``text``.

    Blank, malformed and truncated lines, and lines with anything after their
    first value, parse to nothing.  Each line is parsed once, in Arrow batches; the
    function counts as nondeterministic so that no filter is pushed below it
    and evaluated again.  With ``terminated`` (a boolean column) a line that the stream
    ended before its line break is dropped: the client never reads it.
    """
    if terminated:
        lines = lines.where(F.coalesce(F.col(terminated), F.lit(False)))
    parse = F.pandas_udf(_parse, PARSED).asNondeterministic()
    return lines.withColumn("__p", parse(col_of(line))).select(*lines.columns, "__p.*")


def parse_status_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Drop blank and malformed lines and unknown types; keep the rest."""
    parsed = parse_lines(lines, line)
    return parsed.where(F.col("type").isin(KNOWN_TYPES)).drop("is_null_line")


def to_status_lines(df: DataFrame, type_col: str = "type", data_col: str = "data") -> DataFrame:
    """One JSON object ``{"type", "data"}`` per row (parse-equal to the
    server's lines, not byte-equal)."""
    return df.select("*", F.to_json(F.struct(F.col(type_col).alias("type"),
                                             F.col(data_col).alias("data"))).alias("line"))


# ------------------------------------------------------------------ N1-N3

def tool_status(calls: DataFrame) -> DataFrame:
    """A start of a known tool emits its status; an unknown start emits
    nothing; any end emits THINKING."""
    mapping = F.create_map(*[x for kv in TOOL_STATUS.items() for x in map(F.lit, kv)])
    status = (F.when(F.col("kind") == "end", F.lit(THINKING))
              .when(F.col("kind") == "start", mapping[F.col("tool_name")]))
    return calls.withColumn("status", status).where(F.col("status").isNotNull())


def latest_status(requests: DataFrame, events: DataFrame, req: str = "request_id") -> DataFrame:
    """The latest status per request; THINKING before the first one."""
    last = events.groupBy(req).agg(F.max_by("status", "seq").alias("__s"))
    return (requests.select(req).distinct().join(last, req, "left")
            .select(req, F.coalesce("__s", F.lit(THINKING)).alias("status")))


def status_spans(events: DataFrame, req: str = "request_id", bucket_s: int = 6 * 3600, bucket_rows: int | None = None) -> DataFrame:
    """Time spent in each status per request (until the next status);
    the last status of a request has no end and is counted without time.
    The next-status lookup is bucketed in time, or with ``bucket_rows`` by rank, so a hot request is split."""
    spans = W.with_rank_bucket(events, req, ["ts_us", "seq"], bucket_rows) if bucket_rows else W.with_bucket(events, "ts_us", bucket_s * 1_000_000)
    spans = W.lead_across(spans, req, "ts_us", ["ts_us", "seq"], "ts_us", "__next")
    return spans.groupBy(req, "status").agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.sum(F.col("__next") - F.col("ts_us")).alias("time_us"))


# ------------------------------------------------------------------ N4-N6

def reply_text(data: Column, data_kind: Column, text: Column | None = None) -> Column:
    """Object with a truthy ``text`` -> that text; other object or list
    -> its JSON text; string -> itself.  ``text`` is null when falsy (S4)."""
    return F.when(data_kind == "object", F.coalesce(text, data)).otherwise(data)


def final_reply(lines: DataFrame, req: str = "request_id", line: str = "line") -> DataFrame:
    """N4 + N5: reduce each request's stream to one outcome.

    The first error (or a ``null`` line, on which the client throws) wins and
    stops reading; else the last final; else the empty string.
    """
    parsed = parse_lines(lines, line)
    is_abort = (F.col("type") == "error") | F.col("is_null_line")
    # min/max of (seq, ...) structs: nulls (rows of other kinds) are ignored
    per_req = parsed.groupBy(req).agg(
        F.min(F.when(is_abort, F.struct(F.col("seq"), F.col("data")))).alias("__abort"),
        F.max(F.when(F.col("type") == "final",
                     F.struct(F.col("seq"), F.col("data"), F.col("data_kind"), F.col("text")))).alias("__fin"))
    reply = reply_text(F.col("__fin.data"), F.col("__fin.data_kind"), F.col("__fin.text"))
    return per_req.select(
        req,
        F.when(F.col("__abort").isNotNull(), F.lit("error"))
         .when(F.col("__fin").isNotNull(), F.lit("final")).otherwise(F.lit("empty")).alias("outcome"),
        F.when(F.col("__abort").isNotNull(), F.col("__abort.data"))
         .when(F.col("__fin").isNotNull(), reply).otherwise(F.lit("")).alias("reply"))


def status_label(df: DataFrame, status: str = "status") -> DataFrame:
    """Label per status, falling back to the THINKING label.

    The label table is a fixed four-entry constant, so it is a map literal
    looked up in the projection: no join, no extra job."""
    labels = F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv])
    return df.withColumn("label", F.coalesce(labels[F.col(status)], F.lit(STATUS_LABELS[THINKING])))


# ------------------------------------------------------------------ N7

def outcome_class(text) -> Column:
    """(helper, outcome) of a response text by its template prefix."""
    t = col_of(text)
    helper, outcome = None, None
    for h, o, prefix in OUTCOME_PREFIXES:
        cond = t.startswith(prefix)
        helper = F.when(cond, F.lit(h)) if helper is None else helper.when(cond, F.lit(h))
        outcome = F.when(cond, F.lit(o)) if outcome is None else outcome.when(cond, F.lit(o))
    return F.struct(helper.otherwise(F.lit("other")).alias("helper"),
                    outcome.otherwise(F.lit("answer")).alias("outcome"))


def outcome_counts(responses: DataFrame, text: str = "response") -> DataFrame:
    """Responses per helper and outcome class."""
    c = outcome_class(text)
    return (responses.select(c["helper"].alias("helper"), c["outcome"].alias("outcome"))
            .groupBy("helper", "outcome").agg(F.count(F.lit(1)).alias("n_responses")))
