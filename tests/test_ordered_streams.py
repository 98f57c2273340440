"""Sessions, admin state and late rows as streams against the batch forms and a direct simulation."""

import os
import random
import subprocess
import sys
import tempfile
from types import SimpleNamespace

from pyspark import cloudpickle
from pyspark.sql import functions as F

from storelens.operators import sessions as C
from storelens.plans.stream_queries import c04_stream
from storelens.streaming import activity as SA
from storelens.streaming import ordered as SO

BASE = 1_700_000_100  # on a sweep


def _parts(spark, parts):
    return [spark.createDataFrame([(i, BASE + s, seq, kind) for i, s, seq, kind in rows], "user_id long, s long, event_id long, event_type string")
            .selectExpr("user_id", "timestamp_micros(s * 1000000) AS ts", "event_id", "event_type") for rows in parts]


def _random(seed):
    """Activities of a few ids, arriving up to 600 s late over four parts, then a closing event."""
    r = random.Random(seed)
    rows = [(r.randint(1, 4), r.choice([r.randint(0, 40_000), 300 * r.randint(0, 130)]), k, r.choice(["view", "view", "signup", "error"])) for k in range(160)]
    parts = [[], [], [], []]
    for row in rows:
        parts[min(3, (row[1] + r.randint(0, 599)) // 10_050)].append(row)
    for p in parts:
        r.shuffle(p)
    return rows, [p for p in parts if p] + [[(-1, 900_000, 10_000, "view")]]


def _log(spark, rows):
    kind = {"signup": "login_ok", "error": "logout"}
    return spark.createDataFrame([(i, (BASE + s) * C.US, seq, kind.get(k, "chat")) for i, s, seq, k in rows],
                                 "session_id long, ts_us long, seq long, kind string")


def test_swept_sessions_and_roles_equal_the_batch_forms(spark):
    for seed in (1, 2):
        rows, parts = _random(seed)
        log = _log(spark, rows)
        got = SA.run_in_triggers(_parts(spark, parts), lambda s: SO.stream_swept_sessions(s, 600), "test-c4")
        want = C.session_spans(C.sessionize_swept(log))
        cols = ["session_id", "session_no", "start_us", "last_us", "n_activities", "removed_us"]
        assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
        roles = SA.run_in_triggers(_parts(spark, parts), lambda s: SO.stream_roles(s, 600), "test-c8")
        batch = C.role_as_of(log).select(roles.columns)
        assert sorted(map(tuple, roles.collect())) == sorted(map(tuple, batch.collect()))


def test_state_survives_a_restart_and_counts_follow_the_sweeps(spark):
    rows, parts = _random(3)
    got = SA.run_in_batches(_parts(spark, parts), lambda s: SO.stream_sweep_counts(s, 600), "test-c5")
    want = C.sweep_counts(C.sessionize_swept(_log(spark, rows)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("removed_us", "n_removed").collect()))


def test_late_rows_are_kept_with_their_batch(spark):
    parts = [[(1, 0, 1, "view"), (1, 1000, 2, "view")], [(2, 5000, 3, "view"), (2, 939, 4, "view"), (2, 940, 5, "view"), (2, 941, 6, "view")],
             [(3, 4939, 7, "view"), (3, 4940, 8, "view"), (3, 100, 9, "view"), (3, 4941, 10, "view")], [(-1, 900_000, 11, "view")]]
    out = SA.ticks_with_late_rows(_parts(spark, parts), "test-late", 300, 60)
    got = {r.tick_start_us // C.US - BASE: (r.n_on_time, r.n_late, r.late_batch) for r in out.collect()}
    # after the first part the watermark is 940: rows on it are late, as Spark has it; after the second it is 4940
    assert got == {0: (1, 1, 2), 900: (2, 2, 1), 4800: (2 + 0, 2, 2) if 5000 // 300 * 300 == 4800 else (1, 2, 2)}
    assert sum(a + b for a, b, _ in got.values()) == sum(map(len, parts)) - 1


def test_the_gate_repeats_a_batch_without_doubling_it(spark):
    from storelens.session import scratch_path
    from storelens.streaming.late import LateGate

    gate = LateGate(spark, scratch_path(spark, "test-gate"), 60)
    first, second = (p.withColumnRenamed("user_id", "session_id") for p in _parts(spark, [[(1, 0, 1, "a"), (1, 500, 2, "a")], [(1, 100, 3, "b"), (1, 600, 4, "b")]]))
    for batch, number in ((first, 0), (first, 0), (second, 1), (second, 1)):
        gate(batch, number)
    assert [(r.event_id, r.batch_id) for r in gate.late(first.schema).collect()] == [(3, 1)]
    on_time = spark.read.schema(first.schema).option("recursiveFileLookup", "true").parquet(f"{gate.base}/on_time")
    assert sorted(r.event_id for r in on_time.collect()) == [1, 2, 4]
    assert LateGate(spark, scratch_path(spark, "test-gate-empty"), 60).late(first.schema).count() == 0


def test_the_processor_loads_where_the_library_is_not_installed():
    out = subprocess.run([sys.executable, "-c", "import sys, pickle; p = pickle.load(sys.stdin.buffer); print(type(p).__name__, p.out)"],
                         input=cloudpickle.dumps(SO.SweptSessions("roles", 600, 300, 0)), capture_output=True, cwd=tempfile.mkdtemp(), timeout=60,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.split() == [b"SweptSessions", b"roles"], out.stderr.decode()


def test_the_registered_streams_run_in_a_session_of_the_default_state_store(spark):
    own = spark.conf.get(SO.STATE_STORE)
    plain = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    rows, _ = _random(4)
    t = SimpleNamespace(spark=spark, events=_parts(spark, [rows])[0])
    spark.conf.set(SO.STATE_STORE, plain)
    try:
        got = c04_stream(t)
        assert spark.conf.get(SO.STATE_STORE) == plain
    finally:
        spark.conf.set(SO.STATE_STORE, own)
    want = C.session_spans(C.sessionize_swept(_log(spark, rows)))
    cols = ["session_id", "session_no", "start_us", "last_us", "n_activities", "removed_us"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
