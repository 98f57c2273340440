"""Rows that a watermark would drop, kept (C6, C7 and other windows).

Spark drops a row that arrives after the watermark has passed it, and only counts it.
``LateGate`` stands before the windows: every micro-batch is parted by the watermark
that the batches before it make, on-time rows go on to the stateful query, late rows go to a table
of their own.  A batch is written under a hidden name and renamed whole, and a batch that
is repeated after a failure finds its folder there and is left as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


class LateGate:
    def __init__(self, spark: SparkSession, base: str, delay_s: int, event_time: str = "ts"):
        self.spark, self.base, self.delay_s, self.event_time = spark, base.rstrip("/"), delay_s, event_time

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _latest_us(self, batch_id: int) -> int | None:
        """Latest event time of the batches before ``batch_id``; their folders carry it in their names."""
        place, fs = self._place("batches")
        if not fs.exists(place):
            return None
        names = [f.getPath().getName().split("_") for f in fs.listStatus(place)]
        known = [int(n[2]) for n in names if n[0] == "batch" and int(n[1]) < batch_id and n[2] != "none"]
        return max(known) if known else None

    def _done(self, batch_id: int) -> bool:
        place, fs = self._place("batches")
        return fs.exists(place) and any(f.getPath().getName().startswith(f"batch_{batch_id}_") for f in fs.listStatus(place))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch``: part one micro-batch by the watermark before it."""
        if self._done(batch_id):
            return
        latest = self._latest_us(batch_id)
        # as Spark keeps it: whole milliseconds, and a row on the watermark is late
        limit = None if latest is None else (latest // 1000 - self.delay_s * 1000) * 1000
        us = F.unix_micros(self.event_time)
        late = F.coalesce(us <= F.lit(limit), F.lit(False)) if limit is not None else F.lit(False)
        hidden = f"{self.base}/hidden/{uuid.uuid4().hex}"
        batch.withColumn("__late", late.cast("int")).write.partitionBy("__late").parquet(hidden)
        written = self.spark.read.schema(StructType([*batch.schema.fields])).option("recursiveFileLookup", "true").parquet(hidden)
        top = written.agg(F.max(us)).first()[0]
        source, fs = self._place(hidden[len(self.base) + 1:])
        self._place("batches")[1].mkdirs(self._place("batches")[0])
        # on-time rows are published first: a batch counts as done once its folder of late rows stands
        ready, _ = self._place(f"on_time/batch_{batch_id}")
        on_time, _ = self._place(f"{hidden[len(self.base) + 1:]}/__late=0")
        if fs.exists(on_time) and not fs.exists(ready):
            fs.mkdirs(ready.getParent())
            if not fs.rename(on_time, ready):
                raise RuntimeError(f"could not publish {ready}")
        done, _ = self._place(f"batches/batch_{batch_id}_{'none' if top is None else top}")
        if not fs.rename(source, done):
            raise RuntimeError(f"could not publish {done}")

    def run(self, stream: DataFrame, **trigger) -> None:
        """Part everything that ``stream`` has now."""
        (stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.base}/gate-state")
         .trigger(**(trigger or {"availableNow": True})).start().awaitTermination())

    def on_time(self, schema: StructType) -> DataFrame:
        """The on-time rows as a stream, for the stateful query.  Its micro-batches are whole ones of
        the gate (a folder appears at once), so with the same delay it drops none of them."""
        place, fs = self._place("on_time")
        fs.mkdirs(place)
        return self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.base}/on_time")

    def late(self, schema: StructType) -> DataFrame:
        """The late rows with the number of the batch that brought them (``batch_id``)."""
        place, fs = self._place("batches")
        batches = [f.getPath() for f in fs.listStatus(place)] if fs.exists(place) else []
        folders = [(int(p.getName().split("_")[1]), f"{p.toString()}/__late=1") for p in batches]
        found = [(b, f) for b, f in folders if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f))]
        if not found:
            return self.spark.createDataFrame([], StructType([*schema.fields]).add("batch_id", "long"))
        rows = self.spark.read.schema(schema).parquet(*[f for _, f in found])
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/batch_(\d+)_[^/]*/__late=1/", 1)
        return rows.withColumn("batch_id", number.cast("long"))
