"""Benchmark decontamination: size-partitioned MinHash containment search.

Finds short test items inside long documents.  A MinHash of a whole long document
would drown a short item, so items are partitioned by size (number of distinct
five-word shingles, in powers of two) and a document is searched, for each size
class u, through overlapping windows of two adjacent blocks of u shingles: a
contained item then fills a fixed share of one window.  Each window's 64 minima
are looked up among the items' minima of the same order; one agreement makes a
candidate.  Candidates are verified by the exact share of the item's distinct
shingles (as words, not hashes) that the whole document holds, at least 0.8.

The benchmark is the query set: it is cut into blocks of at most
``BLOCK_BYTES`` of text, and each block is sent to the tasks that read the
documents, so what a task holds is bounded whatever the benchmark's size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import n_groups, released
from storelens.llm.order_minhash import normalised
from storelens.llm.wordhash import FEW_BYTES, U64, blocks, shingle_hashes, word_hashes

SHINGLE = 5
CONTAINMENT = 0.8
ORDERS = 64
#: Text of the benchmark items that travel to the tasks at once.
BLOCK_BYTES = 8 << 20

_MUL = np.random.default_rng(5).integers(1, 1 << 63, ORDERS, dtype=np.uint64) | U64(1)


def _shingles(words: list[bytes]) -> list[tuple]:
    return [tuple(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


@dataclass
class ItemIndex:
    """Searchable block of benchmark items."""

    ids: list = field(default_factory=list)
    shingles: list[frozenset] = field(default_factory=list)
    #: size class -> per order: (sorted minima, item numbers in that order)
    minima: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @staticmethod
    def build(items: list[tuple]) -> "ItemIndex":
        """``items``: (id, normalised text).  Items under five words have no
        shingle and are not searched for."""
        index = ItemIndex()
        by_class: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            own = frozenset(_shingles(text.split()))
            if not own:
                continue
            words, _, _, _ = word_hashes([text])
            hashes = np.unique(shingle_hashes(words, SHINGLE))
            size = max(8, 1 << (len(hashes) - 1).bit_length())
            by_class.setdefault(size, []).append((len(index.ids), (hashes[None, :] * _MUL[:, None]).min(axis=1)))
            index.ids.append(item_id)
            index.shingles.append(own)
        for size, found in by_class.items():
            table = np.stack([m for _, m in found], axis=1)
            order = np.argsort(table, axis=1, kind="stable")
            index.minima[size] = (np.take_along_axis(table, order, axis=1), np.array([i for i, _ in found])[order])
        return index

    def candidates(self, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Distinct (text number, item number) rows whose minima agree somewhere.

        ``hashes`` are the shingles of many texts in order, ``owner`` their texts.
        """
        if not len(hashes):
            return np.zeros((0, 2), dtype=np.int64)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        place = np.arange(len(hashes)) - np.repeat(first, np.diff(np.r_[first, len(hashes)]))
        found = []
        cuts = {u: np.flatnonzero(place % u == 0) for u in self.minima}
        for m in range(ORDERS):
            ranked = hashes * _MUL[m]
            for u, (table, numbers) in self.minima.items():
                cut = cuts[u]
                block = np.minimum.reduceat(ranked, cut)
                who = owner[cut]
                window = block.copy()  # each block with its right neighbour in the same text
                same = who[:-1] == who[1:]
                window[:-1][same] = np.minimum(block[:-1], block[1:])[same]
                left = np.searchsorted(table[m], window, side="left")
                right = np.searchsorted(table[m], window, side="right")
                for w in np.flatnonzero(right > left):
                    found.extend((who[w], i) for i in numbers[m, left[w]:right[w]])
        return np.unique(np.array(found, dtype=np.int64).reshape(-1, 2), axis=0)

    def search(self, texts: list[bytes], threshold: float) -> list[tuple[int, int, int, int]]:
        """(text number, item number, item's shingles, shared shingles) of verified finds."""
        out = []
        need = int(round(threshold * 1_000_000))
        for lo, hi in blocks(texts, FEW_BYTES):
            words, owner, _, _ = word_hashes(texts[lo:hi])
            hashes = shingle_hashes(words, SHINGLE)
            inside = owner[:len(hashes)] == owner[SHINGLE - 1:] if len(hashes) else np.zeros(0, dtype=bool)
            last, own = -1, frozenset()
            for t, i in self.candidates(hashes[inside], owner[:len(hashes)][inside]):
                if t != last:
                    last, own = t, frozenset(_shingles(texts[lo + t].split()))
                shared = len(self.shingles[i] & own)
                if shared * 1_000_000 >= need * len(self.shingles[i]):
                    out.append((int(lo + t), int(i), len(self.shingles[i]), shared))
        return out


def _slices(batches, rows: int = 512):
    """The batches in slices of a few rows, so that few texts are open at once."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def item_blocks(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES):
    """The benchmark as indexes of at most about ``block_bytes`` of text each."""
    rows = bench.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    n = n_groups(rows, "text", block_bytes)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield ItemIndex.build([(r["item_id"], normalised(r["text"])) for r in part.toLocalIterator()])


def contaminated(docs: DataFrame, bench: DataFrame, threshold: float = CONTAINMENT, id_col: str = "doc_id",
                 text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_item, n_shared for every document that holds an item.

    ``n_item`` counts the item's distinct shingles, ``n_shared`` those that the whole
    document holds.  Null and empty texts hold nothing; repeated rows and items
    give repeated results; an empty benchmark gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = {"doc_id": rows.schema["doc_id"].dataType.simpleString(), "item_id": bench.schema[item_id_col].dataType.simpleString()}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, n_item long, n_shared long"
    found = None
    for index in item_blocks(bench, item_id_col, item_text_col, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(index)  # at most block_bytes of text

        @released
        def find(batches, sent=sent):
            index = sent.value
            for b in _slices(batches):
                hits = index.search([normalised(t) for t in b.column("text").to_pylist()], threshold) if index.ids else []
                ids = b.column("doc_id")
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([h[0] for h in hits], pa.int64())), pa.array([index.ids[h[1]] for h in hits]).cast(pa_item),
                     pa.array([h[2] for h in hits], pa.int64()), pa.array([h[3] for h in hits], pa.int64())],
                    ["doc_id", "item_id", "n_item", "n_shared"])

        from pyspark.sql.pandas.types import to_arrow_type
        pa_item = to_arrow_type(bench.schema[item_id_col].dataType)
        part = rows.mapInArrow(find, schema)
        found = part if found is None else found.unionAll(part)
    return found


def decontaminate(docs: DataFrame, bench: DataFrame, threshold: float = CONTAINMENT, text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; no shuffle, one pass per block of items."""
    out = docs
    for index in item_blocks(bench, item_id_col, item_text_col, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        @released
        def clean(batches, sent=sent):
            for b in _slices(batches):
                at = b.schema.get_field_index(text_col)
                hits = sent.value.search([normalised(t) for t in b.column(at).to_pylist()], threshold) if sent.value.ids else []
                keep = np.ones(b.num_rows, dtype=bool)
                keep[[h[0] for h in hits]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(clean, docs.schema)
    return out
