"""Sessions and admin state as streams (C4, C5, C8): rows of an id in event-time order.

Rows may come out of order within the watermark's delay.  ``transformWithState`` keeps
each id's waiting rows in state until the watermark passes them, then takes them in
(ts, seq) order, so the result does not depend on how they arrived.  An id has one timer, at
the earlier of its first waiting row and its session's removal sweep; state of a removed session
goes, and what stays of an id is its number of sessions.

Such a stream asks two things of a session that others don't: a state store with column families
(``with_column_families`` starts it under one), and a processor that the driver's own Python worker can
load.  That worker has neither the driver's import path nor files added to the job, so this
module travels by value.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from storelens.operators.sessions import ACTIVITY_KINDS, SESSION_TTL_S, SWEEP_S, US
from storelens.session import SCALE_CONF

cloudpickle.register_pickle_by_value(sys.modules[__name__])
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"

SESSION_SCHEMA = "session_id long, session_no long, start_us long, last_us long, n_activities long, removed_us long, removed_ts timestamp"
ROLE_SCHEMA = "session_id long, seq long, ts_us long, session_no long, is_admin boolean"
_OPEN = "sessions long, start_us long, last_us long, n long, is_admin boolean, due_ms long"


class SweptSessions(StatefulProcessor):
    """One id: its waiting rows and its open session under the sweep rule of C4.

    ``out`` is ``sessions`` (a row when a session's removal sweep has passed) or ``roles`` (a
    row per chat, with the admin flag in effect).
    """

    def __init__(self, out: str, ttl_s: int, sweep_s: int, t0_us: int):
        self.out, self.ttl_us, self.sweep_us, self.t0_us = out, ttl_s * US, sweep_s * US, t0_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts_us long, seq long, kind string")
        self.open = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        return self._advance(key[0], [(r.ts_us, r.seq, r.kind) for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._advance(key[0], [], timerValues.getCurrentWatermarkInMs(), fired=expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass

    def _removal(self, last_us: int) -> int:
        """The first sweep strictly after the session's time is up."""
        return self.t0_us + self.sweep_us * ((last_us + self.ttl_us - self.t0_us) // self.sweep_us + 1)

    def _advance(self, key, new: list, watermark_ms: int, fired: int | None = None) -> Iterator[Row]:
        final_us = max(watermark_ms, 0) * 1000  # no row up to here will come any more
        held = self.open.get() if self.open.exists() else None
        sessions, start, last, n, admin, due_ms = held or (0, None, None, 0, False, None)
        if due_ms == fired:
            due_ms = None
        waiting = [tuple(r) for r in self.waiting.get()]
        had = bool(waiting)
        waiting = sorted(waiting + new)
        ready = [r for r in waiting if r[0] <= final_us]
        waiting = waiting[len(ready):]
        out = []

        def remove():
            removed = self._removal(last)
            if self.out == "sessions":
                out.append(Row(session_id=key, session_no=sessions, start_us=start, last_us=last, n_activities=n, removed_us=removed,
                               removed_ts=_instant(removed)))

        for ts, seq, kind in ready:
            if kind in ACTIVITY_KINDS:
                if last is not None and ts >= self._removal(last):
                    remove()
                    last = None
                if last is None:
                    sessions, start, n, admin = sessions + 1, ts, 0, False
                last, n = ts, n + 1
                admin = admin or kind == "login_ok"
                if self.out == "roles" and kind == "chat":
                    out.append(Row(session_id=key, seq=seq, ts_us=ts, session_no=sessions, is_admin=admin))
            elif kind == "logout":
                admin = False
        if last is not None and self._removal(last) <= final_us:
            remove()
            start, last, n, admin = None, None, 0, False
        if waiting:
            self.waiting.put(waiting)
        elif had:
            self.waiting.clear()
        times = ([waiting[0][0]] if waiting else []) + ([self._removal(last)] if last is not None else [])
        wanted = max(-(-min(times) // 1000), watermark_ms + 1) if times else None
        if wanted != due_ms:
            if due_ms is not None:
                self.handle.deleteTimer(due_ms)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.open.update((sessions, start, last, n, admin, wanted))
        return iter(out)


def _instant(us: int):
    import datetime

    return datetime.datetime.fromtimestamp(us // US, datetime.timezone.utc).replace(microsecond=us % US)


def with_column_families(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """``run()`` with queries started under the state store that ``transformWithState`` needs; the session's own choice comes back."""
    own = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, SCALE_CONF[STATE_STORE])
    try:
        return run()
    finally:
        spark.conf.set(STATE_STORE, own)


def _ordered(stream: DataFrame, out: str, schema: str, delay_s: int, ttl_s: int, sweep_s: int, t0_us: int, event_time: str = "") -> DataFrame:
    rows = (stream.where(F.col("kind").isin(*ACTIVITY_KINDS, "logout") & F.col("ts").isNotNull())
            .select("session_id", "ts", F.unix_micros("ts").alias("ts_us"), F.col("seq").cast("long").alias("seq"), "kind")
            .withWatermark("ts", f"{delay_s} seconds"))
    return rows.groupBy("session_id").transformWithState(SweptSessions(out, ttl_s, sweep_s, t0_us), schema, "append", "EventTime",
                                                         eventTimeColumnName=event_time)


def stream_swept_sessions(stream: DataFrame, delay_s: int = 600, ttl_s: int = SESSION_TTL_S, sweep_s: int = SWEEP_S, t0_us: int = 0) -> DataFrame:
    """C4: one row per session of ``(session_id, ts, seq, kind)``, once its removal sweep has passed the watermark.

    Equal to ``sessionize_swept`` for rows at most ``delay`` late, in whatever order they arrive.
    """
    return _ordered(stream, "sessions", SESSION_SCHEMA, delay_s, ttl_s, sweep_s, t0_us, "removed_ts")


def stream_sweep_counts(stream: DataFrame, delay_s: int = 600, ttl_s: int = SESSION_TTL_S, sweep_s: int = SWEEP_S, t0_us: int = 0) -> DataFrame:
    """Sessions removed by each sweep, once no more can fall to it; a window aggregate behind the sessions' stream."""
    sessions = stream_swept_sessions(stream, delay_s, ttl_s, sweep_s, t0_us)
    counts = sessions.groupBy(F.window("removed_ts", f"{sweep_s} seconds", startTime=f"{t0_us % (sweep_s * US)} microseconds").alias("w")).agg(
        F.count(F.lit(1)).alias("n_removed"))
    return counts.select(F.unix_micros("w.start").alias("removed_us"), "n_removed")


def stream_roles(stream: DataFrame, delay_s: int = 600, ttl_s: int = SESSION_TTL_S, sweep_s: int = SWEEP_S, t0_us: int = 0) -> DataFrame:
    """The admin flag in effect at each chat, released in order as the watermark passes it.

    Equal to ``role_as_of`` for rows at most ``delay`` late.  The flag and the open session leave the
    state with the session's removal sweep.
    """
    return _ordered(stream, "roles", ROLE_SCHEMA, delay_s, ttl_s, sweep_s, t0_us)
