import json
import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from storelens.operators import status as N
from tests.conftest import rows

ODD = ["", "   ", "{bad", '{"type": "final", "da', "null", "5", "[1, 2]", '{"type": "other", "data": 1}']


def _final(kind, i):
    data = {"s": f"napis {i}", "js": json.dumps({"text": f"w {i}"}), "obj": {"text": f"t {i}", "k": i},
            "empty": {"text": "", "k": i}, "list": [{"type": "text", "text": f"l {i}"}]}[kind]
    return json.dumps({"type": "final", "data": data})


def _reduce(lines):
    """A plain reducer with the client's rules."""
    out = ""
    for line in lines:
        if not line.strip():
            continue
        try:
            obj = json.loads(line)
        except ValueError:
            continue
        if obj is None:
            return ("error", None)
        if not isinstance(obj, dict):
            continue
        if obj.get("type") == "final":
            out = obj.get("data")
        elif obj.get("type") == "error":
            return ("error", obj.get("data"))
    if isinstance(out, (dict, list)):
        text = out.get("text") if isinstance(out, dict) else None
        return ("final", text if text else json.dumps(out, separators=(",", ":"), ensure_ascii=False))
    return ("final" if out != "" else "empty", out)


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 100_000))
def test_final_reply_equals_plain_reducer(spark, seed):
    rnd = random.Random(seed)
    data, expected = [], {}
    for req in range(12):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            c = rnd.random()
            if c < 0.3:
                lines.append(json.dumps({"type": "status", "data": rnd.choice(["RAG", "DATABASE"])}))
            elif c < 0.65:
                lines.append(_final(rnd.choice(["s", "js", "obj", "empty", "list"]), req))
            elif c < 0.75:
                lines.append(json.dumps({"type": "error", "data": f"Błąd {req}"}))
            else:
                lines.append(rnd.choice(ODD))
        for i, line in enumerate(lines):
            data.append((req, i, line))
        expected[req] = _reduce(lines) if lines else None
    df = spark.createDataFrame(data, "request_id long, seq long, line string")
    got = {r.request_id: (r.outcome, r.reply) for r in N.final_reply(df).collect()}
    for req, exp in expected.items():
        if exp is None:
            assert req not in got
        else:
            assert got[req] == exp, (req, [d for d in data if d[0] == req])


def test_parse_codec_and_labels(spark):
    df = spark.createDataFrame([(1, 1, '{"type": "status", "data": "RAG"}'), (1, 2, ""), (1, 3, "{bad"),
                                (1, 4, '{"type": "other", "data": 1}'), (1, 5, '{"type": "final", "data": [1]}')],
                               "request_id long, seq long, line string")
    parsed = N.parse_status_lines(df)
    assert rows(parsed, "seq", "type", "data_kind") == [(1, "status", "string"), (5, "final", "array")]
    back = N.parse_status_lines(N.to_status_lines(parsed.select("seq", "type", "data")).select("seq", "line"))
    assert rows(back, "seq", "type", "data") == [(1, "status", "RAG"), (5, "final", "[1]")]
    st_ = spark.createDataFrame([("RAG",), ("NOPE",)], "status string")
    assert rows(N.status_label(st_), "status", "label") == [("NOPE", "Myślę"), ("RAG", "Przeszukuję dokumenty")]


def test_tool_status_latest_and_spans(spark):
    calls = spark.createDataFrame([(1, 1, 0, "start", "AgentBazyDanych"), (1, 2, 10, "end", None),
                                   (1, 3, 15, "start", "unknown"), (2, 4, 0, "start", "AgentPrzeszukaniaInternetu")],
                                  "request_id long, seq long, ts_us long, kind string, tool_name string")
    st_ = N.tool_status(calls)
    assert rows(st_, "seq", "status") == [(1, "DATABASE"), (2, "THINKING"), (4, "INTERNET")]
    reqs = spark.createDataFrame([(1,), (2,), (3,)], "request_id long")
    assert rows(N.latest_status(reqs, st_)) == [(1, "THINKING"), (2, "INTERNET"), (3, "THINKING")]
    spans = rows(N.status_spans(st_), "request_id", "status", "time_us")
    assert spans == [(1, "DATABASE", 10), (1, "THINKING", None), (2, "INTERNET", None)]


def test_outcome_counts(spark):
    texts = ["Odmowa dostępu. Niedozwolone polecenie", "Dokonano modyfikacji 3 wierszy", "Dane z bazy: []",
             "BŁĄD MySQL: x | Próbowano wykonać: y", "Błąd komunikacji z agentem RAG: z", "Cześć!"]
    df = spark.createDataFrame([(t,) for t in texts], "response string")
    assert rows(N.outcome_counts(df)) == [("database", "error", 1), ("database", "modified", 1),
                                          ("database", "refused", 1), ("database", "rows", 1),
                                          ("documents", "error", 1), ("other", "answer", 1)]


def test_lines_that_are_not_one_json_value_are_ignored(spark):
    lines = ['{"type":"final","data":"ok"} junk', '{"type":"final","data":"a"}{"type":"final","data":"b"}', '{"type":"final","data":NaN}',
             '{"type":"final","data":"one","data":"last"}', ' {"type":"final","data":1.0}\t', '{"type":"final"}']
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, line string")
    assert rows(N.parse_status_lines(df), "seq", "data", "data_kind") == [(3, "last", "string"), (4, "1", "other"), (5, None, None)]


def test_falsy_texts_give_the_objects_json(spark):
    data = ['{"text":0}', '{"text":false}', '{"text":null}', '{"text":""}', '{"text":7}', '{"text":"x"}', '[1]', '"s"']
    df = spark.createDataFrame([(i, f'{{"type":"final","data":{d}}}') for i, d in enumerate(data)], "seq long, line string")
    got = N.parse_status_lines(df).select("seq", N.reply_text(F.col("data"), F.col("data_kind"), F.col("text")).alias("r"))
    assert rows(got, "seq", "r") == [(0, '{"text":0}'), (1, '{"text":false}'), (2, '{"text":null}'), (3, '{"text":""}'),
                                     (4, "7"), (5, "x"), (6, "[1]"), (7, "s")]


def test_an_unterminated_last_line_is_not_read(spark):
    df = spark.createDataFrame([(1, '{"type":"status","data":"RAG"}', True), (2, '{"type":"final","data":"x"}', False)],
                               "seq long, line string, ended boolean")
    assert rows(N.parse_lines(df, terminated="ended"), "seq", "type") == [(1, "status")]


def test_one_parse_per_row_under_a_filter(spark):
    df = spark.createDataFrame([(1, '{"type":"status","data":"RAG"}')], "seq long, line string")
    plan = N.parse_status_lines(df).where(F.col("type") == "final")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
