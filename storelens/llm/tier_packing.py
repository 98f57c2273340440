"""Hierarchical packing of token ids into windows of several context sizes.

Documents are worked through where they are read, a bounded amount of text at a
time (a chunk), with no shuffle.  In a chunk

1. a document's ids are cut into whole longest windows from its start, and the rest
   is routed to the smallest context size (tier) that holds it;
2. tiers are packed from long to short: a window opens with the tier's longest rest,
   and its gap is filled from shorter tiers, with the longest whole rest that fits
   and, when none does, with the first ids of a longer one, which goes back under
   what is left of it;
3. what the last window can't fill is cut into powers of two, so no window is padded;
4. windows of one context size are dealt into step groups of equal numbers of ids,
   in turn and back again by attention cost (the sum of squared piece lengths), so that the
   groups of a chunk cost about the same.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import quiet_threads, release, tokenizer_file

END_ID = 2
#: Context sizes, longest first: powers of two.
TIERS = (4096, 2048, 1024, 512, 256)
#: Ids of a step group.
STEP_IDS = 1 << 16
#: Text of a chunk (whole documents: a longer one is a chunk of its own).
CHUNK_BYTES = 8 << 20
#: Distinct words whose ids a task remembers before it forgets the newer half.
CACHE_WORDS = 400_000

#: White space that the vocabulary drops, made plain spaces before a text is cut at those.
_BLANKS = ("\n", "\t", "\r")
#: A word of plain Latin letters, which no normalisation changes but for their case, and marks after it, which are one piece.
_PLAIN = re.compile("([A-Za-zªµºÀ-ÖØ-öø-\u012f\u0131-\u024f]+)([-!#$%&()*+,./:;=?@\\[\\]^_`{}~\"]*)")
_ENCODERS: dict = {}


class _Memory(dict):
    """Remembers what ``make`` gave for a key, if the key is short."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        found = self.make(key)
        if len(key) <= 64:
            self[key] = found
        return found

    def trim(self, most: int) -> None:
        """Keep the oldest half, mostly the frequent words, of more than ``most``."""
        if len(self) > most:
            for key in list(self)[most // 2:]:
                del self[key]


class SpacedEncoder:
    """``Tokenizer.encode(text, add_special_tokens=False)`` with the ids of words remembered.

    For vocabularies whose pattern drops white space: a piece never reaches over
    white space, and neither normalisation nor the pattern looks across it, so a text may be
    cut there.  Words of the usual shapes go to the tokenizer's model at once, all others
    through the whole library.  A text that holds one of the vocabulary's added tokens goes
    to the library uncut, since those are found before anything else.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        quiet_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.encode(" a\n b", add_special_tokens=False).ids != self.tokenizer.encode("a b", add_special_tokens=False).ids:
            raise ValueError("a vocabulary that drops white space is needed")
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the vocabulary's letters for bytes: printable ones stand for themselves, the rest follow from 256 on
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.letters = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}
        self.pieces, self.units = _Memory(self._piece), _Memory(self._unit)
        self.cache_words = cache_words

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        """Ids of a text without spaces."""
        if not unit:
            return b""
        shape = _PLAIN.fullmatch(unit)
        if not shape:
            return self._library(unit)
        word, marks = shape.groups()
        return self.pieces[word.lower()] + self.pieces[marks] if marks else self.pieces[word.lower()]

    def encode(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            return np.frombuffer(self._library(text), dtype="<u4")
        for blank in _BLANKS:
            text = text.replace(blank, " ")
        ids = b"".join(map(self.units.__getitem__, text.split(" ")))
        self.pieces.trim(self.cache_words)
        self.units.trim(self.cache_words)
        return np.frombuffer(ids, dtype="<u4")


def _encoder(path: str) -> SpacedEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = SpacedEncoder(path)
    return _ENCODERS[path]


class _Rests:
    """Unplaced rests by length: (document, start) of each, and the lengths in order."""

    def __init__(self):
        self.by_length: dict[int, list[tuple[int, int]]] = {}
        self.lengths: list[int] = []

    def add(self, length: int, document: int, start: int) -> None:
        if length not in self.by_length:
            self.by_length[length] = []
            insort(self.lengths, length)
        self.by_length[length].append((document, start))

    def take(self, place: int) -> tuple[int, int, int]:
        length = self.lengths[place]
        found = self.by_length[length].pop()
        if not self.by_length[length]:
            del self.by_length[length], self.lengths[place]
        return length, *found


def pack(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (context size, pieces) that hold documents of the given sizes.

    A piece is (document, start, length).  Every window is full: its context size is one
    of ``tiers``, or for the last ones of all a smaller power of two.
    """
    longest = tiers[0]
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    rests = _Rests()
    for document, size in enumerate(sizes):
        whole = size - size % longest
        windows.extend((longest, [(document, start, longest)]) for start in range(0, whole, longest))
        if size > whole:
            rests.add(size - whole, document, whole)
    left: list[tuple[int, int, int]] = []
    for context, shorter in zip(tiers, (*tiers[1:], 0)):
        while rests.lengths and rests.lengths[-1] > shorter:  # routed to this tier
            length, document, start = rests.take(len(rests.lengths) - 1)
            pieces, gap = [(document, start, length)], context - length
            while gap and rests.lengths:
                place = bisect_right(rests.lengths, gap)  # the longest whole rest that fits, else the next longer one's first ids
                length, document, start = rests.take(place - 1 if place else 0)
                used = min(length, gap)
                pieces.append((document, start, used))
                gap -= used
                if used < length:
                    rests.add(length - used, document, start + used)
            if gap:  # nothing is left to fill it with
                left = pieces
            else:
                windows.append((context, pieces))
    at = sum(p[2] for p in left)
    while left:  # the last window, cut into powers of two
        context = 1 << (at.bit_length() - 1)
        at -= context
        pieces, gap = [], context
        while gap:
            document, start, length = left[0]
            used = min(length, gap)
            pieces.append((document, start, used))
            gap -= used
            left[0] = (document, start + used, length - used)
            if used == length:
                left.pop(0)
        windows.append((context, pieces))
    return windows


def step_groups(windows: list[tuple[int, list[tuple[int, int, int]]]], step_ids: int = STEP_IDS) -> list[int]:
    """The step group of each window: one context size a group, at most ``step_ids`` ids.

    Windows go from the costliest down to the group that costs least so far and is not full.
    """
    by_context: dict[int, list[int]] = {}
    for k, (context, _) in enumerate(windows):
        by_context.setdefault(context, []).append(k)
    groups = [0] * len(windows)
    first = 0
    for context in sorted(by_context, reverse=True):
        mine = by_context[context]
        most = max(1, step_ids // context)
        n = -(-len(mine) // most)
        costs = {k: sum(length * length for _, _, length in windows[k][1]) for k in mine}
        heap = [(0, 0, g) for g in range(n)]  # cost, windows, group
        size, extra = divmod(len(mine), n)
        for k in sorted(mine, key=lambda k: (-costs[k], k)):
            cost, held, g = heapq.heappop(heap)
            groups[k] = first + g
            if held + 1 < size + (g < extra):
                heapq.heappush(heap, (cost + costs[k], held + 1, g))
        first += n
    return groups


def pack_documents(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                   end_id: int = END_ID, tiers: tuple[int, ...] = TIERS, step_ids: int = STEP_IDS,
                   chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The ids of all documents in windows: one row per piece.

    doc_id, start (the document's ids before the piece), length, ids (binary, little-endian
    unsigned 32-bit), doc_tokens (the document's ids with the end id), sequence_id, offset (the window's ids
    before the piece), context (the window's size, always full), step_id.

    Ids are those of the tokenizers library's plain ``encode`` without special tokens, then
    ``end_id``; a null text is its end id alone.  Each row is a document of its own, repeated
    ids and null ids too.  Sequence and step ids are unique over the table, not gapless.
    The result depends only on the rows of each partition in their order.  An empty table
    gives no pieces; other columns are not read.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True) or tiers[0] * 2 > 1 << 31:
        raise ValueError("tiers are powers of two, longest first")
    path = vocabulary or tokenizer_file("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shape = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, context int, step_id long"
    names = [part.split(" ")[0] for part in shape.split(", ")]

    def work(batches):
        base = TaskContext.get().partitionId() << 36
        encoder = _encoder(path)
        next_sequence = next_step = 0
        doc_ids: list = []
        held: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal doc_ids, held, size, next_sequence, next_step
            windows = pack([len(h) for h in held], tiers)
            steps = step_groups(windows, step_ids)
            columns: list[list] = [[] for _ in names]
            for k, (context, pieces) in enumerate(windows):
                offset = 0
                for document, start, length in pieces:
                    ids = held[document]
                    for column, value in zip(columns, (doc_ids[document], start, length, ids[start:start + length].tobytes(), len(ids),
                                                       base + next_sequence + k, offset, context, base + next_step + steps[k])):
                        column.append(value)
                    offset += length
            next_sequence += len(windows)
            next_step += max(steps) + 1
            types = {"ids": pa.binary(), "context": pa.int32()}
            doc_ids, held, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.int64())) for n, c in zip(names, columns)], names)

        end = np.array([end_id], dtype="<u4")
        for b in batches:
            lengths = pc.binary_length(b.column("text")).to_pylist()
            for a in range(0, b.num_rows, 256):
                some = b.slice(a, 256)
                for k, (doc_id, text) in enumerate(zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist())):
                    if held and size + lengths[a + k] > chunk_bytes:
                        yield flush()
                    doc_ids.append(doc_id)
                    held.append(np.append(encoder.encode(text), end))
                    size += lengths[a + k] + 64
        if held:
            yield flush()
        release()

    return rows.mapInArrow(work, shape)
