"""Structured Streaming forms of the session sweeper.

The reference keeps sessions in a dict and sweeps it every 300 s.  As a
stream, state lives in Spark's state store and the watermark evicts it:
a session is emitted once no later activity can reach it (append mode), and
per-tick counts are emitted once their tick has closed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from storelens.operators.sessions import SESSION_TTL_S, SWEEP_S, US
from storelens.functions.times import epoch_us, instant_from_us
from storelens.plans.derived import KIND_SQL
from storelens.functions.windows import floor_div
from storelens.session import cut_lineage, drop_scratch, scratch_path
from storelens.streaming.late import LateGate


def activity_stream(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming activity log from Parquet event files arriving in ``folder``:
    ``(session_id, ts, seq, kind)`` with ``ts`` as an event-time timestamp."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    events = reader.parquet(folder)
    return events.select(F.col("user_id").alias("session_id"),
                         instant_from_us(epoch_us("ts")).alias("ts"),
                         F.col("event_id").alias("seq"), F.expr(KIND_SQL).alias("kind"))


def stream_sessions(stream: DataFrame, ttl_s: int = SESSION_TTL_S, delay_s: int = 600,
                    kinds=("chat",)) -> DataFrame:
    """One row per session, emitted when it can no longer grow.

    Session windows merge activities at most ``ttl`` apart (the client rule
    of C3); the watermark lets a session close ``delay`` after its end.
    """
    s = (stream.where(F.col("kind").isin(list(kinds)))
         .withWatermark("ts", f"{delay_s} seconds")
         .groupBy("session_id", F.session_window("ts", f"{ttl_s} seconds").alias("w"))
         .agg(F.count(F.lit(1)).alias("n_activities"), F.max("ts").alias("last_ts")))
    return s.select("session_id",
                    F.unix_micros(F.col("w.start")).alias("start_us"),
                    F.unix_micros(F.col("last_ts")).alias("last_us"),
                    F.unix_micros(F.col("w.end")).alias("end_us"), "n_activities")


def stream_ticks(stream: DataFrame, tick_s: int = SWEEP_S, delay_s: int = 60) -> DataFrame:
    """Activities per sweep tick (tumbling window), emitted once closed."""
    t = (stream.withWatermark("ts", f"{delay_s} seconds")
         .groupBy(F.window("ts", f"{tick_s} seconds").alias("w"))
         .agg(F.count(F.lit(1)).alias("n_activities")))
    return t.select(F.unix_micros(F.col("w.start")).alias("tick_start_us"),
                    F.unix_micros(F.col("w.end")).alias("tick_end_us"), "n_activities")


def run_available(streaming: DataFrame, name: str) -> DataFrame:
    """Run a streaming query over everything available now into a Parquet
    folder (append mode) under the shared checkpoint folder; return the
    written rows as a batch DataFrame.  The folder is removed once they are read."""
    spark = streaming.sparkSession
    base = scratch_path(spark, name)
    _drain(streaming, base)
    return _collected(spark, streaming.schema, base)


def _drain(streaming: DataFrame, base: str) -> None:
    (streaming.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())


def _collected(spark: SparkSession, schema: StructType, base: str) -> DataFrame:
    out = cut_lineage(spark.read.schema(schema).parquet(f"{base}/out"))
    drop_scratch(base)
    return out


def run_in_batches(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Let event files arrive part after part: each part is written to a folder
    and the query ``build(activity stream)`` is started again on the same
    checkpoint until it has taken in what is new, so state is carried from batch to
    batch and over restarts.  Returns all rows that it wrote."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    base = scratch_path(spark, name)
    streaming = None
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        streaming = build(activity_stream(spark, f"{base}/in", schema))
        _drain(streaming, base)
    return _collected(spark, streaming.schema, base)


def run_in_triggers(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], name: str,
                    rows_per_file: int = 2_000_000) -> DataFrame:
    """As ``run_in_batches`` in one query start: every part is written as the same number of
    files, and the file source takes that many, oldest first, per trigger.  A micro-batch after
    the watermark moved still lets rows in that the watermark before it would (Spark
    keeps both, for chained operators)."""
    base = scratch_path(parts[0].sparkSession, name)
    streaming = build(_arriving(parts, base, rows_per_file))
    _drain(streaming, base)
    return _collected(streaming.sparkSession, streaming.schema, base)


def _arriving(parts: list[DataFrame], base: str, rows_per_file: int = 2_000_000) -> DataFrame:
    """The activity stream of parts written one after another below ``base``, a part per trigger."""
    files = max(1, max(-(-p.count() // rows_per_file) for p in parts))
    for part in parts:
        part.repartition(files).write.mode("append").parquet(f"{base}/in")
    return activity_stream(parts[0].sparkSession, f"{base}/in", parts[0].schema, max_files_per_trigger=files)


def ticks_with_late_rows(parts: list[DataFrame], name: str, tick_s: int = SWEEP_S, delay_s: int = 60) -> DataFrame:
    """C7 behind a gate for late rows: per tick the rows that the stream counted (``n_on_time``), those that came
    too late for it (``n_late``), their sum, and the last micro-batch that brought late ones."""
    spark = parts[0].sparkSession
    base = scratch_path(spark, name)
    stream = _arriving(parts, base)
    gate = LateGate(spark, f"{base}/gate", delay_s)
    gate.run(stream)
    ticks = stream_ticks(gate.on_time(stream.schema), tick_s, delay_s)
    _drain(ticks, base)
    us = tick_s * US
    late = gate.late(stream.schema).groupBy((floor_div(F.unix_micros("ts"), us) * us).alias("tick_start_us")).agg(
        F.count(F.lit(1)).alias("late"), F.max("batch_id").alias("late_batch"))
    counted = spark.read.schema(ticks.schema).parquet(f"{base}/out").select("tick_start_us", "n_activities")
    both = counted.join(late, "tick_start_us", "full")
    n = [F.coalesce(c, F.lit(0)) for c in ("n_activities", "late")]
    out = cut_lineage(both.select("tick_start_us", n[0].alias("n_on_time"), n[1].alias("n_late"), (n[0] + n[1]).alias("n_all"), "late_batch"))
    drop_scratch(base)
    return out


def in_arrival_order(events: DataFrame, slices: int, delay_s: int, flush_s: int, late_every: int = 0) -> list[DataFrame]:
    """``slices`` parts of the events by time of arrival, then one closing event.

    A row arrives less than ``delay_s`` after its event time, by a hash of its id, so parts overlap in time.  With
    ``late_every`` every row whose id that divides arrives with the last part, however old it is.
    """
    us = epoch_us("ts")
    delay = F.pmod(F.xxhash64("event_id"), F.lit(delay_s * US)) if delay_s else F.lit(0)
    parts, high = in_time_order(events, slices, flush_s)
    low = events.agg(F.min(us)).first()[0]
    step = (high - low) // slices + 1
    at = F.least(F.floor((us + delay - low) / step), F.lit(slices - 1))
    if late_every:
        at = F.when(F.col("event_id") % late_every == 0, slices - 1).otherwise(at)
    return [*[events.where(at == k) for k in range(slices)], parts[-1]]


def in_time_order(events: DataFrame, slices: int, flush_s: int) -> tuple[list[DataFrame], int]:
    """``slices`` consecutive parts of the events by time, then one closing event
    ``flush_s`` after the last, which lets the watermark pass every open window;
    and the time of the last real event in microseconds."""
    us = epoch_us("ts")
    low, high = events.agg(F.min(us), F.max(us)).first()
    step = (high - low) // slices + 1
    parts = [events.where((us >= low + k * step) & (us < low + (k + 1) * step)) for k in range(slices)]
    closing = events.orderBy(us.desc()).limit(1).select(*[
        {"ts": instant_from_us(F.lit(high + flush_s * US)).cast(f.dataType), "user_id": F.lit(-1).cast(f.dataType),
         "event_type": F.lit("view")}.get(f.name, F.col(f.name)).alias(f.name) for f in events.schema.fields])
    return [*parts, closing], high
