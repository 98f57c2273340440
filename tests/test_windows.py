import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from storelens.functions import windows as W
from storelens.functions.times import epoch_us
from tests.conftest import SF_SMALL


def _data(spark, seed, n=120):
    rnd = random.Random(seed)
    rows = [(rnd.randint(0, 3), rnd.randint(0, 50) * 7, i, rnd.choice([None, 1, 2, 3])) for i in range(n)]
    return spark.createDataFrame(rows, "k long, ts long, seq long, v long")


@settings(max_examples=3, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([5, 30, 1000]))
def test_bucketed_windows_equal_plain_windows(spark, seed, bucket):
    df = W.with_bucket(_data(spark, seed), "ts", bucket)
    order = ["ts", "seq"]
    w = Window.partitionBy("k").orderBy(*order)
    plain = df.select("seq", F.lag("ts").over(w).alias("lag"), F.lead("ts").over(w).alias("lead"),
                      F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("rs"),
                      F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("rl"))
    got = W.lag_across(df, "k", "ts", order, "ts", "lag")
    got = W.lead_across(got, "k", "ts", order, "ts", "lead")
    got = W.running_sum_across(got, "k", order, "v", "rs")
    got = W.running_last_across(got, "k", order, F.col("v"), "rl")
    a = sorted(tuple(r) for r in plain.collect())
    b = sorted(tuple(r) for r in got.select("seq", "lag", "lead", "rs", "rl").collect())
    assert a == b


@settings(max_examples=3, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from(["row_number", "dense_rank"]), st.integers(1, 4))
def test_two_phase_top_k_equals_plain_ranking(spark, seed, method, k):
    rnd = random.Random(seed)
    df = spark.createDataFrame([(rnd.randint(0, 2), i, rnd.randint(0, 6)) for i in range(200)],
                               "g long, id long, score long")
    order = [F.col("score").desc(), F.col("id")] if method == "row_number" else [F.col("score").desc()]
    fn = F.row_number() if method == "row_number" else F.dense_rank()
    plain = df.withColumn("rank", fn.over(Window.partitionBy("g").orderBy(*order)).cast("long")) \
        .where(f"rank <= {k}")
    got = W.top_k_per_group(df, ["g"], order, k, method=method, salt_by=["id"], salts=5)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, got.select(*plain.columns).collect()))


@settings(max_examples=3, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from(["row_number", "dense_rank", "rank"]), st.integers(1, 4))
def test_salted_top_k_path_equals_plain_ranking(spark, seed, method, k):
    """Above the window group limit threshold the salted two-phase path runs."""
    rnd = random.Random(seed)
    df = spark.createDataFrame([(rnd.randint(0, 2), i, rnd.randint(0, 6)) for i in range(200)],
                               "g long, id long, score long")
    order = [F.col("score").desc(), F.col("id")] if method == "row_number" else [F.col("score").desc()]
    fn = {"row_number": F.row_number, "dense_rank": F.dense_rank, "rank": F.rank}[method]()
    plain = df.withColumn("rank", fn.over(Window.partitionBy("g").orderBy(*order)).cast("long")) \
        .where(f"rank <= {k}")
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "0")
        got = W.top_k_per_group(df, ["g"], order, k, method=method, salt_by=["id"], salts=5)
        assert "__salt" in got._jdf.queryExecution().analyzed().toString()
        res = sorted(map(tuple, got.select(*plain.columns).collect()))
    finally:
        spark.conf.set(key, old)
    assert sorted(map(tuple, plain.collect())) == res


def test_epoch_us_ignores_session_time_zone(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "ts")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ny = {r.event_id: r.us for r in ev.select("event_id", epoch_us("ts").alias("us")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    import pyarrow.parquet as pq
    t = pq.read_table(f"{SF_SMALL}/events.parquet", columns=["event_id", "ts"]).to_pydict()
    from datetime import datetime, timezone
    for eid, ts in zip(t["event_id"][:50], t["ts"][:50]):
        exp = int((ts.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()
                  * 1_000_000)
        assert abs(ny[eid] - exp) <= 1


def test_buckets_by_rank_split_a_hot_id_and_change_nothing(spark):
    """One id with a third of all rows inside one time bucket: equal results, and no window far above the others."""
    import random

    from storelens.operators import sessions as C
    from storelens.operators import status as N

    r = random.Random(5)
    data = [(0 if k % 3 == 0 else r.randint(1, 300), r.randint(0, 6 * 3600) * C.US if k % 3 == 0 else r.randint(0, 400_000) * C.US, k,
             r.choice(["chat", "chat", "chat", "login_ok", "logout"])) for k in range(6000)]
    log = spark.createDataFrame(data, "session_id long, ts_us long, seq long, kind string").repartition(4)
    same = lambda a, b: sorted(map(tuple, a.select(b.columns).collect())) == sorted(map(tuple, b.collect()))
    assert same(C.sessionize(log, bucket_rows=250), C.sessionize(log))
    assert same(C.sessionize_swept(log, bucket_rows=250), C.sessionize_swept(log))
    assert same(C.role_as_of(log, bucket_rows=250), C.role_as_of(log))
    events = log.selectExpr("session_id AS request_id", "ts_us", "seq", "kind AS status")
    assert same(N.status_spans(events, bucket_rows=250), N.status_spans(events))
    placed = W.with_rank_bucket(log, "session_id", ["ts_us", "seq"], 250)
    sizes = sorted(n for _, n in placed.groupBy(W.BUCKET).count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2] and len(sizes) >= 20
    assert max(placed.groupBy("session_id", W.BUCKET).count().agg({"count": "max"}).first()) < 6000 / 3 / 4
