"""Toxicity scores of whole documents by a small recurrent network.

The network (``toxicity_net``) is trained in numpy on a bounded sample of
labelled texts: at most ``SAMPLE_PER_CLASS`` documents of either class, those with
the least hash of their id, so the sample does not depend on the layout of the
data.  A fifth of the sample sets the probability scale.  Only texts are inputs.
Scoring covers every overlapping window of every text, in tasks that
hold nothing but the network and one batch of texts.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import crc_mod, release, released
from storelens.llm.toxicity_net import ToxicityNet, whole_passes, words_of

#: Bound of the training sample, for each class.
SAMPLE_PER_CLASS = 1500
#: Batches the network learns from at most, and texts in one.
UPDATES, BATCH = 190, 48


def training_sample(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = SAMPLE_PER_CLASS,
                    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """Texts, targets and natural weights of at most ``per_class`` labelled documents of either class.

    Ids are chosen first (ids and labels only), then their texts are read.
    Rows that repeat a labelled id count once; null ids and labels are left out.
    """
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & allowed).groupBy(id_col)
             .agg(F.max(F.col(label_col).cast("int")).alias("y")))
    known = known.join(docs.select(id_col).distinct(), id_col, "left_semi")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    turn = F.xxhash64(F.col(id_col))
    ids = [known.where(F.col("y") == y).orderBy(turn, id_col).limit(per_class).select(id_col, "y") for y in (0, 1)]
    chosen = {r[0]: r[1] for part in ids for r in part.collect()}  # at most 2 * per_class numbers
    if not chosen:
        return [], np.zeros(0), np.zeros(0)
    spark = docs.sparkSession
    # bounded by the sample's size; an Arrow table, as a list of rows would start Python workers of another kind
    picked = spark.createDataFrame(pa.table({"c_id": pa.array(list(chosen), pa.int64())}))
    own = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("d_text"))
    texts = own.join(F.broadcast(picked), F.col("d_id") == F.col("c_id")).select("c_id", "d_text").dropDuplicates(["c_id"]).collect()
    texts.sort(key=lambda r: (hash_of(r[0]), r[0]))
    target = np.array([chosen[r[0]] for r in texts], dtype=np.float64)
    size = {y: max(1, int((target == y).sum())) for y in (0, 1)}
    weight = np.array([counts.get(int(y), 0) / size[int(y)] for y in target])
    return [words_of(r[1]) for r in texts], target, weight


def hash_of(number: int) -> int:
    """A fixed scrambling of an id, for an order without meaning."""
    return (int(number) * 0x9E3779B97F4A7C15 ^ (int(number) >> 7)) & 0xFFFFFFFFFFFFFFFF


def train(texts: list[bytes], target: np.ndarray, weight: np.ndarray, updates: int = UPDATES) -> ToxicityNet:
    """A network fitted on four fifths of the sample and calibrated on the rest.

    Without texts of both classes the network stays as it starts, with its
    scores held below one half.
    """
    net = ToxicityNet()
    if not len(target) or target.min() == target.max():
        net.scale, net.shift = 1e-3, 20.0 if len(target) and target[0] == 1 else -20.0
        return net
    rank = np.empty(len(target), dtype=np.int64)  # place within the own class, so both parts hold both classes
    for y in (0, 1):
        rows = np.flatnonzero(target == y)
        rank[rows] = np.arange(len(rows))
    held = rank % 5 == 4
    fit = np.flatnonzero(~held)
    own = [texts[i] for i in fit]
    net.prime(own, target[fit])
    check = np.flatnonzero(held) if len(set(target[held].tolist())) == 2 else np.arange(len(target))
    shown = [texts[i] for i in check]
    # rounds of training, each twice as long; the network that the held fifth likes best is kept
    best, done, step = (np.inf, None), 0, 10
    turns = whole_passes(target[fit])  # the rounds go on where the one before stopped
    while done <= updates:
        net.calibrate(net.logits(shown), target[check], weight[check])
        p = np.clip(net.scores(shown), 1e-6, 1 - 1e-6)
        loss = -(weight[check] * (target[check] * np.log(p) + (1 - target[check]) * np.log(1 - p))).sum()
        if loss < best[0]:
            best = (loss, copy.deepcopy(net))
        if done == updates:
            break
        step = min(step, updates - done)
        net.fit(own, target[fit], updates=step, batch=BATCH, turns=turns)
        done, step = done + step, step * 2
    return best[1]


def _scores(net: ToxicityNet, column: pa.Array, rows: int = 512) -> np.ndarray:
    """Scores of a batch's texts, a few rows at a time."""
    parts = [net.scores([words_of(t) for t in column.slice(a, rows).to_pylist()]) for a in range(0, len(column), rows)]
    return np.concatenate([np.zeros(0), *parts])


def score(docs: DataFrame, net: ToxicityNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row; null texts are scored as empty ones."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # fixed size: the tables of the network
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    @released
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_scores(sent.value, b.column("text")))],
                                             ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def without_toxic(docs: DataFrame, net: ToxicityNet, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    @released
    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(text_col)
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                yield part.filter(pa.array(_scores(sent.value, part.column(at)) < limit))

    return docs.mapInArrow(run, docs.schema)


def fit_on(docs: DataFrame, labels: DataFrame, fold: int = 5, out: int = 0) -> ToxicityNet:
    """The network learned from labelled rows whose crc32(doc_id as text) mod ``fold`` is not ``out``."""
    net = train(*training_sample(docs, labels, crc_mod(F.col("doc_id"), fold) != out))
    release()  # the sample's texts and the networks that were not kept
    return net
