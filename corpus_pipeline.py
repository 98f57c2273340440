"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  A stage sees whatever its
predecessor kept, and its decisions take effect:

1. ``toxicity``: documents that the network scores 0.5 or more go;
2. ``near_dedup``: one document of each near-duplicate class stays, the least id;
3. ``suffix_dedup``: bytes covered by a 50-byte string of an earlier document go;
4. ``decontaminate``: documents that hold a benchmark item go;
5. ``bpe``: texts become token ids, and the text is what the ids decode to.

An empty table passes through all stages; extra columns are carried along.
"""

from __future__ import annotations

import gc
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm.byte_bpe import encode, load_ranks
from storelens.llm.common import release, shared_folder, table, tokenizer_file
from storelens.llm.decontamination import decontaminate
from storelens.llm.order_minhash import keep_one_per_class
from storelens.llm.repeated_spans import without_repeats
from storelens.llm.toxicity import fit_on, without_toxic
from storelens.session import drop_scratch


def give_back(spark: SparkSession) -> None:
    """Let the driver collect what the stage before left: its plans, and with them broadcasts and
    shuffle files that nothing refers to any more, are dropped when the JVM collects."""
    gc.collect()
    release()
    if hasattr(spark, "_jvm"):  # not a client session
        spark._jvm.System.gc()


#: Bytes of the batches that go from Spark to Python workers and stand on either side of the pipe at once.
BATCH_BYTES = "1m"


def small_batches(spark: SparkSession) -> None:
    """Batches of bounded bytes for the session's Python workers, unless the session sets its own bound: by
    Spark's default a batch has 10,000 rows, and executors hold what they once needed for such batches from stage to stage."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]):
    @wraps(work)
    def fresh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        small_batches(spark)
        return work(spark, docs, sf_dir)

    return fresh


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network does not reject.

    The network learns from the labelled documents of ``docs``.  Null and empty
    texts score like any text without words.
    """
    return without_toxic(docs, fit_on(docs, table(spark, sf_dir, "labels")))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of every near-duplicate class."""
    return keep_one_per_class(docs)


@_stage
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that earlier ones hold; ``n_chars`` follows the text."""
    left = without_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns of ``docs`` with the text decoded from its token ids, ``n_tokens`` and ``token_ids``."""
    import public_tokenizers

    ranks = load_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    others = [c for c in docs.columns if c not in ("text", "n_tokens", "token_ids")]
    found = encode(docs, ranks, public_tokenizers.PATTERN, carry=others, as_ids=True)
    return found.select(*[F.col("carried").getField(c).alias(c) if c != "text" else F.col("decoded").alias("text")
                          for c in docs.columns if c in others or c == "text"], "n_tokens", "token_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontamination), ("bpe", bpe)]

#: Network scores and ordered sketches can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    A stage's rows are removed once the next stage's are written; the last ones stay, as the result reads them.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_scratch(before)
        before = path
    return docs
