"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import uuid
import zlib
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.session import checkpoint_dir

#: ASCII white space: \t \n \v \f \r and space.  Words are runs of anything else.
WORD_RE = r"[^\x20\x09-\x0D]+"


_LIBC = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table, read as it is."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder: lineage cut, survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written_in_few(df: DataFrame, rows_per_part: int = 200_000) -> DataFrame:
    """As ``checkpointed``, read on in as many partitions as the rows need: rounds over
    small tables then do not write a file per partition of the largest shuffle."""
    kept = checkpointed(df)
    return kept.coalesce(max(1, -(-kept.count() // rows_per_part)))


def text_bytes(text: Column) -> Column:
    """UTF-8 length of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def crc_mod_py(doc_id, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def n_groups(df: DataFrame, text: str, group_bytes: int) -> int:
    """How many groups of about ``group_bytes`` of text the table makes (at least one)."""
    total = df.agg(F.sum(text_bytes(F.col(text)) + 64)).first()[0] or 0
    return max(1, -(-int(total) // group_bytes))


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file (a parameter of the operators that use one)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def release() -> None:
    """Give memory that a Python worker has freed back to the system: workers are
    reused, and what one task leaves would count against the next."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def released(work):
    """``work`` over a task's batches; what it held is given back once its last batch is done."""

    @wraps(work)
    def run(batches):
        yield from work(batches)
        release()  # the generator has ended, so nothing of it is held any more

    return run


def quiet_threads() -> None:
    """One thread per Python worker: Spark's cores are the parallelism."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
