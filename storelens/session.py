"""Session construction and cluster-level settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale.  AQE re-plans joins from runtime sizes (its
# broadcast conversion is itself a size check), splits skewed shuffle
# partitions and coalesces small ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # streaming state (session windows, ticks) off the JVM heap, spillable
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # delete checkpoint files once no DataFrame refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "storelens", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings above.

    On a cluster ``master`` stays None so the launcher decides.  In tests
    ``master='local[*]'`` and a small ``shuffle_partitions`` are passed.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SCALE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session.  When it is unset, a local-mode session (tests,
    local runs) gets a scratch folder of its own; a session with a cluster
    master must name a shared folder, since a machine-local one would not be
    shared.  So must a client session, which cannot tell what it is connected to.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a client session without a local context
        sc = None
    path = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if not path:
        if sc is None or not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster "
                               "(lineage cuts and streaming state are written there)")
        path = tempfile.mkdtemp(prefix="storelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/storelens/{name}-{uuid.uuid4().hex}"


def drop_scratch(path: str) -> None:
    """Remove a folder of :func:`scratch_path` once its rows have been read, on whatever file system it is."""
    spark = SparkSession.getActiveSession()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably (survives executor loss) and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
