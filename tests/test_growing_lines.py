"""Line files that grow between micro-batches, odd status lines, stored distinct-count sketches."""

import json
import os

from pyspark.sql import functions as F

from storelens.operators import reports as R
from storelens.operators import status as N
from storelens.sources.growing_lines import GrowingLines, GrowingLinesReader
from storelens.streaming.status import growing_status_lines
from tests.conftest import SF_SMALL, rows


def _append(path, data):
    with open(path, "ab") as f:
        f.write(data)


def _drain(stream, base):
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(
        availableNow=True).start().awaitTermination()


def test_each_line_of_a_growing_file_comes_once(spark, tmp_path):
    spark.dataSource.register(GrowingLines)
    folder, base = tmp_path / "in", str(tmp_path)
    folder.mkdir()
    a, b = str(folder / "a.jsonl"), str(folder / "b.jsonl")
    open(str(folder / "other.txt"), "w").write("not read\n")

    def stream():
        return spark.readStream.format("growing_lines").option("path", str(folder)).option("rangeBytes", 7).load()

    seen = []
    for step in ([(a, b"one\ntwo\nthr")], [(a, b"ee\n"), (b, "zażółć\n\n".encode())], [(b, b"no break"), (a, b"\r\nlong line without end " + b"x" * 100 + b"\nlast\n")]):
        for path, data in step:
            _append(path, data)
        _drain(stream(), base)
        seen.append(spark.read.parquet(f"{base}/out").count())
    assert seen == [2, 5, 8]
    got = spark.read.parquet(f"{base}/out").collect()
    for path in (a, b):
        whole = open(path, "rb").read()
        lines = whole[:whole.rfind(b"\n") + 1].split(b"\n")[:-1]
        places = [sum(len(x) + 1 for x in lines[:k]) for k in range(len(lines))]
        assert sorted((r.at, r.line) for r in got if r.path == path) == [(p, x.decode()) for p, x in zip(places, lines)]


def test_ranges_of_any_size_give_every_line_once(tmp_path):
    lines = ["", "a", "bb" * 20, "", "ccc", "é" * 9, "d"]
    _append(str(tmp_path / "x.jsonl"), "\n".join(lines).encode() + b"\ntail")
    for size in (1, 2, 3, 5, 8, 13, 1000):
        reader = GrowingLinesReader({"path": str(tmp_path), "rangebytes": str(size)})
        end = reader.latestOffset()
        got = [r for p in reader.partitions({}, end) for batch in reader.read(p) for r in batch.to_pylist()]
        assert [r["line"] for r in sorted(got, key=lambda r: r["at"])] == lines, size
        assert reader.partitions(end, reader.latestOffset()) == []


def test_status_lines_of_a_growing_file(spark, tmp_path):
    folder, base = tmp_path / "in", str(tmp_path)
    folder.mkdir()
    path = str(folder / "r.jsonl")
    _append(path, b'{"type":"status","data":"RAG"}\n{"type":"final","data"')
    _drain(growing_status_lines(spark, str(folder)), base)
    assert rows(spark.read.parquet(f"{base}/out"), "type", "data") == [("status", "RAG")]
    _append(path, b':"ok"}\n{bad\n')
    _drain(growing_status_lines(spark, str(folder)), base)
    assert rows(spark.read.parquet(f"{base}/out"), "type", "data") == [("final", "ok"), ("status", "RAG")]


def test_lone_surrogates_and_huge_numbers_do_not_end_the_job(spark):
    lines = ['{"type":"final","data":"\\ud800x"}', '{"type":"final","data":{"text":"\\udfff"}}', '{"type":"final","data":["\\ud800"]}',
             '{"type":"final","data":1e400}', '{"type":"final","data":{"a":-1e999,"b":2.0}}', '{"type":"\\ud800","data":1}', '{"type":"final","data":"\\ud83d\\ude00"}']
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, line string")
    got = rows(N.parse_status_lines(df).select("seq", "data_kind", N.reply_text(F.col("data"), F.col("data_kind"), F.col("text")).alias("r")), "seq", "data_kind", "r")
    assert got == [(0, "string", "�x"), (1, "object", "�"), (2, "array", '["\\ud800"]'), (3, "null", None),
                   (4, "object", '{"a":null,"b":2}'), (6, "string", "😀")]
    assert json.loads(got[2][2]) == ["\ud800"]


def test_merged_sketches_stay_within_their_bound(spark):
    t = {n: spark.read.parquet(f"{os.path.dirname(SF_SMALL)}/sf0.01/{n}.parquet") for n in ("lineitem", "orders", "part")}
    sketches = R.buyer_sketches(t["lineitem"], t["part"], t["orders"], category="p_brand", lg_k=10)
    span = {"some": ("1993-03", "1996-11")}
    got = dict(R.distinct_in_spans(sketches, span, "p_brand").select("p_brand", "n_buyers").collect())
    within = t["orders"].where(F.date_format("o_orderdate", "yyyy-MM").between(*span["some"]))
    exact = dict(R.distinct_buyers_per_category(t["lineitem"], t["part"], within, "p_brand").collect())
    assert set(got) == set(exact) and all(abs(got[m] - n) <= 3 * 1.04 / 2 ** 5 * n for m, n in exact.items())
