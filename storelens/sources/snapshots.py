"""Tables kept as snapshots: Parquet files plus a manifest that is published last (S3, Q7).

A save writes new files below ``data/`` and then creates ``manifests/<version>.json``, which must
not exist yet.  Until then readers see the version before; a save that is cut off leaves files that
no manifest names.  A manifest lists each file with its row count and the range of the key
column, so an edit reads and rewrites only files that can hold its rows, and names all others as
they are.  Two writers that started from one version both write files, but only one gets to
create the next manifest; the other is told (``Conflict``).  Readers hold the file list of the
version they opened.  Files are never changed or removed here.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer published the version this one was about to."""


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- manifests: one small file per version, made and listed by the driver

    def _path(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        place, fs = self._path("manifests")
        if not fs.exists(place):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(place)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version (the last one by default); None where nothing was published."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            return None
        number = known[-1] if version is None else version
        place, fs = self._path(f"manifests/{number:09d}.json")
        stream = fs.open(place)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, base: int, schema: StructType, key: str | None, files: list[dict]) -> int:
        """Create the manifest after ``base``: whole under another name first, then renamed to a place that must be free
        (one step on HDFS; as good as the file system's rename elsewhere)."""
        body = json.dumps({"version": base + 1, "schema": schema.jsonValue(), "key": key, "files": files})
        hidden, fs = self._path(f"manifests/.{uuid.uuid4().hex}")
        place, _ = self._path(f"manifests/{base + 1:09d}.json")
        out = fs.create(hidden, False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration())
        try:  # a rename that refuses to replace, as streaming checkpoints use it
            context.rename(hidden, place, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as e:
            fs.delete(hidden, False)
            if fs.exists(place):
                raise Conflict(f"version {base + 1} of {self.path} was published by another writer") from e
            raise
        return base + 1

    def _write(self, df: DataFrame, key: str | None) -> list[dict]:
        """Write ``df`` as new files; their names, row counts and key ranges."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        written = self.spark.read.schema(df.schema).parquet(folder)
        aggs = [F.count(F.lit(1)).alias("rows")]
        if key:
            aggs += [F.min(key).alias("low"), F.max(key).alias("high"), F.count(key).alias("known")]
        found = written.groupBy(F.col("_metadata.file_path").alias("path")).agg(*aggs)
        return [r.asDict() for r in found.collect()]  # one row per file

    # -- reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last one by default).  The file list is fixed now: later saves don't show."""
        held = self.manifest(version)
        if held is None:
            raise FileNotFoundError(f"no published version at {self.path}")
        return self._rows(held, held["files"])

    def _rows(self, held: dict, files: list[dict]) -> DataFrame:
        schema = StructType.fromJson(held["schema"])
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f["path"] for f in files])

    # -- writing

    def save(self, df: DataFrame, key: str | None = None) -> int:
        """Publish ``df`` as the next version.  With ``key`` rows are range-partitioned by it, so edits by key meet few files.

        ``df`` may read this very table: nothing of the version before is touched.
        """
        known = self.versions()
        rows = df.repartitionByRange(key).sortWithinPartitions(key) if key else df
        files = self._write(rows, key)
        return self._publish(known[-1] if known else 0, df.schema, key, files)

    def append(self, df: DataFrame) -> int:
        """The last version and the rows of ``df``; no file is rewritten."""
        held = self.manifest()
        schema = StructType.fromJson(held["schema"])
        more = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        return self._publish(held["version"], schema, held["key"], held["files"] + self._write(more, held["key"]))

    def update(self, where: Column, values: dict[str, Column], keys: tuple | None = None) -> tuple[int, int]:
        """``(version, rows)``: rows that satisfy ``where`` (null counts as no) take ``values``.

        Counts rows of which a value changes.  ``keys`` (low, high) bounds the key of the rows meant.
        """
        changed = None
        for name, value in values.items():
            differs = ~F.col(name).eqNullSafe(value)
            changed = differs if changed is None else changed | differs
        hit = self._meant(where, keys)

        def change(rows):
            return rows.select(*[F.when(hit, values[c]).otherwise(F.col(c)).cast(rows.schema[c].dataType).alias(c) if c in values else F.col(c)
                                 for c in rows.columns])

        return self._edit(hit & changed, change, keys)

    def delete(self, where: Column, keys: tuple | None = None) -> tuple[int, int]:
        """``(version, rows)``: without the rows that satisfy ``where`` (null counts as no)."""
        hit = self._meant(where, keys)
        return self._edit(hit, lambda rows: rows.where(~hit), keys)

    def _meant(self, where: Column, keys: tuple | None) -> Column:
        if keys is None:
            return F.coalesce(where, F.lit(False))
        held = self.manifest()
        if not held or not held["key"]:
            raise ValueError("the table was saved without a key")
        return F.coalesce(where & F.col(held["key"]).between(*keys), F.lit(False))

    def _edit(self, hit: Column, change, keys: tuple | None) -> tuple[int, int]:
        held = self.manifest()
        if held is None:
            raise FileNotFoundError(f"no published version at {self.path}")
        files, key = held["files"], held["key"]
        may = files
        if keys is not None:
            may = [f for f in files if f["known"] and f["low"] <= keys[1] and f["high"] >= keys[0]]
        met = (self._rows(held, may).where(hit).groupBy(F.col("_metadata.file_path").alias("path"))
               .agg(F.count(F.lit(1)).alias("n")).collect()) if may else []
        touched = {r.path: r.n for r in met}
        if not touched:
            return held["version"], 0
        schema = StructType.fromJson(held["schema"])
        rows = change(self._rows(held, [f for f in files if f["path"] in touched]))
        new = self._write(rows, key)
        version = self._publish(held["version"], schema, key, [f for f in files if f["path"] not in touched] + new)
        return version, sum(touched.values())
