"""Registered streaming queries (C4-C8): the ``events`` table arrives as files,
slice by slice, a micro-batch each.  A closing event then lets the watermark pass every window, so the result
is complete; ``is_closed`` marks the rows that the events themselves had closed
(their end is before the last event less the delay).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.functions.times import epoch_us
from storelens.operators.sessions import SESSION_TTL_S, SWEEP_S, US
from storelens.plans.activity_queries import C4_SQL, C8_SQL
from storelens.plans.derived import ACTIVITY_SQL, KIND_SQL
from storelens.plans.registry import query
from storelens.streaming import activity as SA
from storelens.streaming import ordered as SO

SESSION_DELAY_S = 600
TICK_DELAY_S = 60
TTL = SESSION_TTL_S * US
TICK = SWEEP_S * US


SLICES = 2
FLUSH_S = 10 * 24 * 3600


def _whole(t, build, name, end, delay_s, last_of="true"):
    parts, _ = SA.in_time_order(t.events, SLICES, FLUSH_S)
    last = t.events.where(last_of).agg(F.max(epoch_us("ts"))).first()[0]
    out = SA.run_in_triggers(parts, build, name)
    return out.withColumn("is_closed", F.col(end) <= F.lit(last - delay_s * US))


@query("c06_stream_sessions", f"""
WITH {ACTIVITY_SQL},
l AS (SELECT *, LAG(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us, seq) AS prev_us
      FROM activity WHERE kind = 'chat'),
s AS (SELECT *, SUM(CASE WHEN prev_us IS NULL OR ts_us - prev_us > {TTL} THEN 1 ELSE 0 END)
                OVER (PARTITION BY session_id ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS sno FROM l),
g AS (SELECT session_id, MIN(ts_us) AS start_us, MAX(ts_us) AS last_us, MAX(ts_us) + {TTL} AS end_us,
             COUNT(*) AS n_activities FROM s GROUP BY session_id, sno)
SELECT *, end_us <= (SELECT MAX(ts_us) FROM activity WHERE kind = 'chat') - {SESSION_DELAY_S * US} AS is_closed FROM g""")
def c06(t):
    return _whole(t, lambda s: SA.stream_sessions(s, SESSION_TTL_S, SESSION_DELAY_S), "c06", "end_us", SESSION_DELAY_S,
                  f"{KIND_SQL} = 'chat'")


@query("c07_stream_ticks", f"""
WITH e AS (SELECT epoch_us(ts) AS ts_us FROM events),
g AS (SELECT (ts_us // {TICK}) * {TICK} AS tick_start_us, (ts_us // {TICK}) * {TICK} + {TICK} AS tick_end_us,
             COUNT(*) AS n_activities FROM e GROUP BY 1, 2)
SELECT *, tick_end_us <= (SELECT MAX(ts_us) FROM e) - {TICK_DELAY_S * US} AS is_closed FROM g""")
def c07(t):
    return _whole(t, lambda s: SA.stream_ticks(s, SWEEP_S, TICK_DELAY_S), "c07", "tick_end_us", TICK_DELAY_S)


ORDER_DELAY_S = 3600
ORDER_SLICES = 3


def _in_order(t, build, name):
    parts = SA.in_arrival_order(t.events, ORDER_SLICES, ORDER_DELAY_S, FLUSH_S)
    return SO.with_column_families(t.spark, lambda: SA.run_in_triggers(parts, build, name))


@query("c04_stream_swept", f"""
WITH s AS ({C4_SQL})
SELECT session_id, session_no, MIN(ts_us) AS start_us, MAX(ts_us) AS last_us, COUNT(*) AS n_activities,
       {TICK} * ((MAX(ts_us) + {TTL}) // {TICK} + 1) AS removed_us
FROM s GROUP BY session_id, session_no""")
def c04_stream(t):
    """C4 as a stream, rows up to an hour late and out of order: equal to the batch form."""
    return _in_order(t, lambda s: SO.stream_swept_sessions(s, ORDER_DELAY_S).drop("removed_ts"), "c04")


@query("c05_stream_sweep_counts", f"""
WITH s AS ({C4_SQL})
SELECT removed_us, COUNT(*) AS n_removed FROM (
  SELECT session_id, session_no, {TICK} * ((MAX(ts_us) + {TTL}) // {TICK} + 1) AS removed_us
  FROM s GROUP BY session_id, session_no)
GROUP BY removed_us""")
def c05_stream(t):
    return _in_order(t, lambda s: SO.stream_sweep_counts(s, ORDER_DELAY_S), "c05")


@query("c08_stream_roles", C8_SQL)
def c08_stream(t):
    """C8 as a stream: rows out of order inside the delay, released as the watermark passes."""
    return _in_order(t, lambda s: SO.stream_roles(s, ORDER_DELAY_S), "c08")


LATE_EVERY = 41


@query("c07_late_rows", f"""
WITH e AS (SELECT event_id, epoch_us(ts) AS ts_us FROM events),
x AS (SELECT min(ts_us) AS low, max(ts_us) AS high, (max(ts_us) - min(ts_us)) // {ORDER_SLICES} + 1 AS step FROM e),
p AS (SELECT *, CASE WHEN event_id % {LATE_EVERY} = 0 THEN {ORDER_SLICES - 1} ELSE least((ts_us - low) // step, {ORDER_SLICES - 1}) END AS part FROM e, x),
w AS (SELECT (max(ts_us) // 1000 - {TICK_DELAY_S * 1000}) * 1000 AS mark FROM p WHERE part < {ORDER_SLICES - 1}),
l AS (SELECT *, part = {ORDER_SLICES - 1} AND ts_us <= mark AS late FROM p, w)
SELECT (ts_us // {TICK}) * {TICK} AS tick_start_us, count(*) FILTER (NOT late) AS n_on_time, count(*) FILTER (late) AS n_late,
       count(*) AS n_all, CASE WHEN bool_or(late) THEN {ORDER_SLICES - 1}::BIGINT END AS late_batch
FROM l GROUP BY 1""")
def c07_late(t):
    """C7 with late rows kept: per tick the rows counted by the stream, those that came too late, and the batch that brought them."""
    return SA.ticks_with_late_rows(SA.in_arrival_order(t.events, ORDER_SLICES, 0, FLUSH_S, LATE_EVERY), "c07-late", SWEEP_S, TICK_DELAY_S)
