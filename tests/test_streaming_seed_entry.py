import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E
from storelens.operators import sessions as C
from storelens.sources import seed as G
from storelens.streaming import activity as SA
from tests.conftest import SF_SMALL


def test_stream_sessions_match_batch_on_closed(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    folder = tempfile.mkdtemp(prefix="storelens-stream-")
    ev.repartition(3).write.mode("overwrite").parquet(folder + "/in")
    stream = SA.activity_stream(spark, folder + "/in", ev.schema)
    got = SA.run_available(SA.stream_sessions(stream, 1800, 600), "test-c6")
    from storelens.plans.derived import activity_log
    batch = C.sessionize(activity_log(ev)).groupBy("session_id", "session_no").agg(
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("last_us"), F.count(F.lit(1)).alias("n"))
    wm = activity_log(ev).where("kind = 'chat'").agg(F.max("ts_us")).first()[0] - 600 * C.US
    closed = {(r.session_id, r.start_us, r.n) for r in batch.collect() if r.last_us + 1800 * C.US <= wm}
    assert {(r.session_id, r.start_us, r.n_activities) for r in got.collect()} == closed
    ticks = SA.run_available(SA.stream_ticks(SA.activity_stream(spark, folder + "/in", ev.schema)), "test-c7")
    assert ticks.agg(F.sum("n_activities")).first()[0] <= ev.count()


def test_seed_distribution_and_keys(spark):
    keys = spark.range(1, 20001).withColumnRenamed("id", "k")
    cust = spark.range(1, 51).withColumnRenamed("id", "c")
    orders = G.seed_orders(keys, "k", cust, "c", 7, 1_767_225_600_000_000, 2026)
    assert orders.count() == 20000
    assert orders.select("id_klienta").distinct().join(cust, F.col("id_klienta") == F.col("c"), "left_anti").count() == 0
    chk = G.distribution_check(orders, "status_zamowienia", G.ORDER_STATUSES, G.ORDER_STATUS_WEIGHTS)
    for r in chk.collect():
        assert abs(r.observed_share - r.expected_share) < 0.02
    c1 = G.seed_customers(cust, "c", 7, 0).collect()
    c2 = G.seed_customers(cust, "c", 7, 0).collect()
    assert c1 == c2 and len({r.email for r in c1}) == 50


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["c_custkey", "c_name", "spend", "n_orders"]
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 70


def test_status_line_stream(spark):
    import os
    from storelens.streaming.status import status_line_stream
    folder = tempfile.mkdtemp(prefix="storelens-lines-")
    with open(os.path.join(folder, "req1.jsonl"), "w") as f:
        f.write('{"type": "status", "data": "RAG"}\n\n{bad\n{"type": "final", "data": {"text": "ok"}}\n')
    with open(os.path.join(folder, "req2.jsonl"), "w") as f:
        f.write('null\n{"type": "error", "data": "x"}\n')
    out = SA.run_available(status_line_stream(spark, folder), "test-s4")
    got = sorted((os.path.basename(r.source_file), r.type, r.data_kind) for r in out.collect())
    assert got == [("req1.jsonl", "final", "object"), ("req1.jsonl", "status", "string"),
                   ("req2.jsonl", "error", "string")]


def test_state_is_carried_over_batches_and_late_rows_are_dropped(spark):
    at = lambda rows: spark.createDataFrame(rows, "user_id long, s long, event_id long, event_type string").selectExpr(
        "user_id", "timestamp_micros(s * 1000000) AS ts", "event_id", "event_type")
    base = 1_700_000_000
    parts = [at([(1, base, 1, "view"), (1, base + 1000, 2, "view")]), at([(1, base + 2000, 3, "view"), (2, base + 2500, 4, "view")]),
             at([(3, base + 50_000, 5, "view")]), at([(1, base + 2100, 6, "view")]), at([(-1, base + 900_000, 7, "view")])]
    got = SA.run_in_batches(parts, lambda s: SA.stream_sessions(s, 1800, 600), "test-batches")
    assert sorted((r.session_id, r.n_activities) for r in got.collect()) == [(1, 3), (2, 1), (3, 1)]


def test_scratch_names_differ_and_folders_go(spark):
    import os
    from storelens.session import drop_scratch, scratch_path
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b
    spark.range(3).write.parquet(a)
    drop_scratch(a)
    assert not os.path.exists(a)
