"""The retrieval chain over chunks: texts, chunks, vectors, index, search, context.

The vectoriser is signed feature hashing with idf weights.  A word (a run of letters
and digits, lower-cased) has a feature, the first five hex digits of its md5; a feature's
dimension and sign are fixed by its number, and its weight follows from how many
chunks hold it.  Weights and values are whole numbers, so sums don't depend on their order.

Both passes over the texts are map-only: counting features sends at most FEATURES counts
a task, and the weights (FEATURES numbers, whatever the corpus) travel to the tasks.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructField, StructType

from storelens.operators.chunking import chunk_documents
from storelens.operators.vectors import DEFAULT_K, assemble_context, nearest_batch
from storelens.session import cut_lineage, drop_scratch, scratch_path
from storelens.sources.snapshots import SnapshotTable

FEATURE_DIGITS = 5
FEATURES = 16 ** FEATURE_DIGITS
DIMS = 256
SCALE = 100
CHUNKS_PER_DOC = 1 << 20
#: Texts whose words are counted at once.
STEP = 2048
#: Letters and digits of any script.
WORD_RE = r"[^\W_]+"

INDEX_SCHEMA = StructType([StructField("chunk_id", LongType()), StructField("doc_id", LongType()), StructField("chunk_no", LongType()),
                           StructField("chunk_text", StringType()), StructField("embedding", ArrayType(FloatType()))])

_words = re.compile(WORD_RE).findall


class _Features(dict):
    """Feature numbers of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        found = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:FEATURE_DIGITS], 16)
        return found


def _counts(texts: list[str | None], features: _Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs of some texts, and how often each occurs."""
    words = [_words((t or "").lower()) for t in texts]
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    found = np.fromiter(map(features.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=len(row))
    pairs, times = np.unique(row * FEATURES + found, return_counts=True)
    return pairs // FEATURES, pairs % FEATURES, times


def feature_counts(texts: DataFrame, text: str = "chunk_text") -> DataFrame:
    """``(feature, n_texts)``: how many texts hold each feature; feature -1 counts all texts.

    Each task adds up its own texts, so at most FEATURES + 1 rows leave it.
    """

    def run(batches):
        features, held, n = _Features(), np.zeros(FEATURES, dtype=np.int64), 0
        for b in batches:
            for a in range(0, b.num_rows, STEP):
                held += np.bincount(_counts(b.column(0).slice(a, STEP).to_pylist(), features)[1], minlength=FEATURES)
            n += b.num_rows
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, some)), pa.array(np.append(n, held[some]))], ["feature", "n"])

    counted = texts.select(F.col(text).cast("string")).mapInArrow(run, "feature long, n long")
    return counted.groupBy("feature").agg(F.sum("n").alias("n_texts"))


def weights_of(counts: DataFrame) -> np.ndarray:
    """Whole-number idf weights of all features (FEATURES numbers come to the driver)."""
    n_texts = np.zeros(FEATURES, dtype=np.float64)
    held = counts.select("feature", "n_texts").toArrow()  # at most FEATURES + 1 rows
    feature, n = (held.column(c).to_numpy() for c in ("feature", "n_texts"))
    total = int(n[feature < 0].sum())
    n_texts[feature[feature >= 0]] = n[feature >= 0]
    return np.round(SCALE * (np.log((1 + total) / (1 + n_texts)) + 1)).astype(np.int64)


def vectorize(df: DataFrame, weights: np.ndarray, text: str = "chunk_text", out: str = "embedding", dims: int = DIMS) -> DataFrame:
    """``df`` with the vector of ``text``: array<float> of whole numbers, all zero for a null text or one without words.

    A feature that occurs c times adds round(weight * (1 + ln c)) to its dimension, or takes it away.
    """

    def run(batches):
        features = _Features()
        feature = np.arange(FEATURES)
        dim, sign = feature % dims, 1 - 2 * (feature // dims % 2)
        for whole in batches:
            for a in range(0, whole.num_rows, STEP):
                b = whole.slice(a, STEP)
                row, found, times = _counts(b.column(text).to_pylist(), features)
                value = sign[found] * np.round(weights[found] * (1 + np.log(times)))
                held = np.bincount(row * dims + dim[found], weights=value, minlength=b.num_rows * dims)  # whole numbers below 2**53: exact
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dims, pa.int32()), pa.array(held.astype(np.float32)))
                yield pa.RecordBatch.from_arrays([*b.columns, vectors], [*b.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, ArrayType(FloatType()))]))


def chunk_ids(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Chunks with one number each: ``doc * CHUNKS_PER_DOC + chunk_no`` (a longer document is refused)."""
    number = F.when(F.col("chunk_no") < CHUNKS_PER_DOC, F.col(doc) * CHUNKS_PER_DOC + F.col("chunk_no")).otherwise(
        F.raise_error(F.lit("a document of more chunks than a chunk number can tell apart")).cast("long"))
    return chunks.select(number.alias("chunk_id"), F.col(doc).alias("doc_id"), "chunk_no", "chunk_text")


class ChunkIndex:
    """A stored chunk index: snapshots of the chunks with their vectors, and of the feature counts behind them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.chunks = SnapshotTable(spark, f"{self.path}/chunks")
        self.counts = SnapshotTable(spark, f"{self.path}/counts")

    def build(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: int = DIMS) -> None:
        """Cut ``docs`` into chunks, count their features, and store chunks with vectors.

        The texts are cut once: chunks are written, counted and vectorised from there.
        """
        cut = scratch_path(self.spark, "chunks")
        chunk_ids(chunk_documents(docs, id_col, text_col), id_col).write.parquet(cut)
        chunks = self.spark.read.parquet(cut)
        self.counts.save(feature_counts(chunks))
        self.chunks.save(vectorize(chunks, weights_of(self.counts.read()), dims=dims))
        drop_scratch(cut)

    def search(self, phrases: DataFrame, k: int = DEFAULT_K, id_col: str = "phrase_id", text_col: str = "phrase") -> DataFrame:
        """The k nearest chunks of every phrase by cosine: id, chunk_id, doc_id, chunk_no, chunk_text, dist, rank."""
        index = self.chunks.read()
        dims = len(index.select("embedding").first()[0])
        asked = vectorize(phrases.select(F.col(id_col).alias("query_id"), F.col(text_col).cast("string").alias("phrase")),
                          weights_of(self.counts.read()), "phrase", "vector", dims)
        hits = nearest_batch(index, asked, k, "chunk_id", metric="cosine")
        return hits.join(index.drop("embedding"), "chunk_id").withColumnRenamed("query_id", id_col)

    def contexts(self, phrases: DataFrame, k: int = DEFAULT_K, id_col: str = "phrase_id", text_col: str = "phrase") -> DataFrame:
        """The context text of every phrase (V7 over the hits)."""
        return assemble_context(self.search(phrases, k, id_col, text_col), id_col, "rank", "chunk_text")


def retrieve(docs: DataFrame, phrases: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """The whole chain on tables: the context of every phrase over the chunks of ``docs``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "chunk-index")
    index = ChunkIndex(spark, path)
    index.build(docs)
    found = cut_lineage(index.contexts(phrases, k))
    drop_scratch(path)
    return found
