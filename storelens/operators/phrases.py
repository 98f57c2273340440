"""Q6 over an index: which rows contain a phrase, for many phrases at once.

The index holds, for every run of one to three characters (gram) of a text, the rows that
hold it: postings of (gram, block of row ids), each a list of places inside the block as
byte-packed differences.  A phrase's longest grams are looked up by an equi-join, a block's
postings are intersected where they all meet, and only rows that hold every gram are read and
verified with the phrase itself, so the answer is the scan's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from storelens.session import cut_lineage
from storelens.sources.snapshots import SnapshotTable

GRAM = 3
BLOCK_ROWS = 1 << 16
#: Text whose postings a task gathers before it gives them out.
GATHER_BYTES = 4 << 20
#: Partial postings that are put together at once.
MERGE_ROWS = 4096
MODES = {"lower": F.lower, "exact": lambda c: c}


def _normal(c, mode: str) -> Column:
    if mode not in MODES:
        raise ValueError(f"{mode}: a phrase index is for {sorted(MODES)}; other modes scan")
    return MODES[mode](c)


def _packed(places: np.ndarray) -> bytes:
    """Ascending places of a block as differences of 7 bits a byte, the high bit marking that more follow."""
    return _packed_lists(places, np.zeros(1, dtype=np.int64))[0].as_py()


def _packed_lists(places: np.ndarray, first: np.ndarray) -> pa.Array:
    """As ``_packed`` for many lists one after another; ``first`` is where each begins."""
    gaps = np.diff(places, prepend=-1) - 1
    gaps[first] = places[first]
    parts = [(gaps >> shift) & 0x7F for shift in (0, 7, 14)]  # a place is below 2**16
    more = [gaps >= 1 << 7, gaps >= 1 << 14]
    rows = np.stack([parts[0] | more[0] << 7, parts[1] | more[1] << 7, parts[2]], axis=1).astype(np.uint8)
    data = rows[np.stack([np.ones(len(gaps), dtype=bool), *more], axis=1)]
    ends = np.cumsum(1 + more[0] + more[1])
    offsets = np.r_[0, ends[np.r_[first[1:], len(gaps)] - 1]].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def _unpacked(data: bytes) -> np.ndarray:
    return _unpacked_lists(pa.array([data], pa.binary()))[0]


def _unpacked_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places of packed lists one after another, and how many each has (none is empty)."""
    lists = pa.concat_arrays([lists])
    offsets = np.frombuffer(lists.buffers()[1], dtype=np.int32)[lists.offset:lists.offset + len(lists) + 1].astype(np.int64)
    raw = np.frombuffer(lists.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]].astype(np.int64)
    last = raw < 0x80
    begin = np.flatnonzero(np.append(True, last[:-1]))
    within = np.arange(len(raw)) - np.repeat(begin, np.diff(np.append(begin, len(raw))))
    steps = np.add.reduceat((raw & 0x7F) << 7 * within, begin) + 1
    first = np.searchsorted(begin, offsets[:-1] - offsets[0])
    n = np.diff(np.append(first, len(steps)))
    sums = np.cumsum(steps)
    return sums - np.repeat(sums[first] - steps[first], n) - 1, n


def _texts_postings(ids: list[int], texts: list[str]):
    """Postings of some texts, a batch per length of gram: gram, block, packed places."""
    uid, rank = np.unique(np.array(ids, dtype=np.int64), return_inverse=True)
    block, place = np.divmod(uid, BLOCK_ROWS)
    raw = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    seen = np.zeros(0x110000, dtype=bool)
    seen[raw] = True
    alphabet = np.flatnonzero(seen)
    code = (np.cumsum(seen, dtype=np.int32) - 1)[raw]
    length = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(rank.astype(np.int32), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(raw), dtype=np.int64)  # characters from here to the text's end
    for n in range(GRAM + 1):
        at = np.flatnonzero(left >= n)
        gram, who = np.zeros(len(at), dtype=np.int64), owner[at]
        for j in range(n):
            gram = gram * len(alphabet) + code[at + j]
        if not n:
            gram, who = np.zeros(len(rank), dtype=np.int64), rank
        if not len(gram):
            continue
        known = None
        if len(alphabet) ** n * len(uid) >= 1 << 62:
            known, gram = np.unique(gram, return_inverse=True)
        key = gram * len(uid) + who
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])]
        gram, who = np.divmod(key, len(uid))
        first = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (block[who[1:]] != block[who[:-1]])))
        own = gram[first] if known is None else known[gram[first]]
        signs = np.empty((len(own), n), dtype="<u4")
        for j in reversed(range(n)):
            own, digit = np.divmod(own, len(alphabet))
            signs[:, j] = alphabet[digit]
        joined = signs.tobytes().decode("utf-32-le")
        yield pa.RecordBatch.from_arrays([pa.array([joined[i * n:(i + 1) * n] for i in range(len(first))], pa.string()),
                                          pa.array(block[who[first]]), _packed_lists(place[who], first)], ["gram", "block", "places"])


def _postings(batches):
    """Partial postings of a task's texts: gram, block, packed places."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
            ids.append(i)
            texts.append(text)
            size += len(text) + 64
            if size >= GATHER_BYTES:
                yield from _texts_postings(ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield from _texts_postings(ids, texts)


def _merged(batches):
    """Whole postings from partial ones in (gram, block) order; a posting has at most BLOCK_ROWS places."""
    made = pa.schema([("gram", pa.string()), ("block", pa.int64()), ("places", pa.binary())])

    def starts(rows):
        grams, block = rows.column("gram").to_pylist(), rows.column("block").to_numpy()
        other = np.array([a != b for a, b in zip(grams[1:], grams)], dtype=bool)
        return np.flatnonzero(np.append(True, other | (block[1:] != block[:-1])))

    def whole(rows, start):
        places, n = _unpacked_lists(rows.column("places").combine_chunks())
        key = np.repeat(np.repeat(np.arange(len(start)), np.diff(np.append(start, rows.num_rows))), n) * BLOCK_ROWS + places
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])]
        of, places = np.divmod(key, BLOCK_ROWS)
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        keys = rows.select(["gram", "block"]).take(pa.array(start)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(keys.column(c).combine_chunks() for c in ("gram", "block")), _packed_lists(places, first)], schema=made)

    left = pa.table({f.name: pa.array([], f.type) for f in made}, schema=made)  # rows of the last key, which may go on
    for b in batches:
        for a in range(0, b.num_rows, MERGE_ROWS):
            left = pa.concat_tables([left, pa.Table.from_batches([b.slice(a, MERGE_ROWS)]).select(made.names).cast(made)])
            start = starts(left)
            if len(start) > 1:
                yield whole(left.slice(0, start[-1]), start[:-1])
                left = left.slice(start[-1])
    if left.num_rows:
        yield whole(left, np.zeros(1, dtype=np.int64))


def _meet(_key, lists):
    """Rows of one block that hold every gram of a phrase, rarest gram first."""
    phrase, block = lists.column("phrase_id")[0].as_py(), lists.column("block")[0].as_py()
    left = None
    if lists.num_rows == lists.column("n_grams")[0].as_py():
        for data in sorted(lists.column("places").to_pylist(), key=len):
            found = _unpacked(data)
            left = found if left is None else np.intersect1d(left, found, assume_unique=True)
            if not len(left):
                break
    ids = np.zeros(0, dtype=np.int64) if left is None else block * BLOCK_ROWS + left
    return pa.table({"phrase_id": pa.array([phrase] * len(ids), pa.int64()), "id": pa.array(ids, pa.int64())})


class PhraseIndex:
    """A stored index over one text column; ``mode`` is ``lower`` or ``exact`` as in ``phrase_match``."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "lower"):
        self.mode = mode
        _normal(F.lit(""), mode)
        self.rows = SnapshotTable(spark, f"{path.rstrip('/')}/rows")
        self.postings = SnapshotTable(spark, f"{path.rstrip('/')}/postings")

    def build(self, df: DataFrame, id_col: str, text_col: str) -> None:
        """Index ``df``.  Null ids and texts are left out (no phrase is in them); an id stands for one row."""
        rows = df.select(F.col(id_col).cast("long").alias("id"), _normal(F.col(text_col), self.mode).alias("text")).where("id is not null and text is not null")
        self.rows.save(rows)
        shape = "gram string, block long, places binary"
        partial = self.rows.read().mapInArrow(_postings, shape)
        self.postings.save(partial.repartition("gram", "block").sortWithinPartitions("gram", "block").mapInArrow(_merged, shape))

    def candidates(self, phrases: DataFrame, id_col: str = "phrase_id", phrase_col: str = "phrase") -> DataFrame:
        """(phrase_id, id): rows that hold every gram of the phrase.  An empty phrase is in every row."""
        asked = phrases.select(F.col(id_col).cast("long").alias("phrase_id"), _normal(F.col(phrase_col), self.mode).alias("p")).where("p is not null")
        size = F.least(F.length("p"), F.lit(GRAM))
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("p") - size + 1), lambda i: F.substr(F.col("p"), i, size)))
        wanted = asked.distinct().select("phrase_id", "p", F.size(grams).cast("long").alias("n_grams"), F.explode(grams).alias("gram"))
        met = wanted.join(self.postings.read(), "gram").select("phrase_id", "block", "n_grams", "places")
        return met.groupBy("phrase_id", "block").applyInArrow(_meet, "phrase_id long, id long")

    def search(self, phrases: DataFrame, id_col: str = "phrase_id", phrase_col: str = "phrase") -> DataFrame:
        """(phrase_id, id, n_verified): rows that contain the phrase, and how many rows were read for it.

        A phrase id stands for one phrase.
        """
        asked = phrases.select(F.col(id_col).cast("long").alias("phrase_id"), _normal(F.col(phrase_col), self.mode).alias("p")).where("p is not null").distinct()
        found = self.candidates(phrases, id_col, phrase_col)
        # the short phrases go to the candidates, so a text is shuffled once; what was read is counted and kept from one pass
        checked = cut_lineage(found.join(asked, "phrase_id").join(self.rows.read(), "id")
                              .select("phrase_id", "id", F.col("text").contains(F.col("p")).alias("holds")))
        verified = checked.groupBy("phrase_id").agg(F.count(F.lit(1)).alias("n_verified"))
        return checked.where("holds").join(verified, "phrase_id").select(F.col("phrase_id").alias(id_col), "id", "n_verified")
