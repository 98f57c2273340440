"""Byte-level BPE encoding and decoding with higher-order functions.

Texts are cut into words (matches of the split pattern) in chunks of bounded size; a
chunk keeps its texts as numbers of its own distinct words.  The words of all chunks
are dealt by hash, so that each distinct word of the corpus is merged once: Spark's
higher-order functions fold the ranked merges over the words as byte arrays, with
the rank map as a literal.  ``aggregate`` carries the word's ids and the ranks of its
neighbouring pairs and makes the least-ranked merge at each step.  Each chunk
gets its words' ids back and puts its texts together; decoding concatenates the
binary pieces of the ids.  What is shuffled is the numbered texts, the distinct
words of each chunk and their ids, all compressed.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from storelens.llm.common import n_groups, release

#: Text of a chunk, and the distinct words at which a chunk ends before that.
CHUNK_BYTES, WORDS = 6 << 20, 250_000
#: Texts of a chunk that go back to Spark at once.
BATCH_ROWS = 256
#: Words longer than this (runs of one kind of character without any break) are merged
#: with a heap in the task: folding copies the word at every merge.
LONG_WORD = 1024  # at most, as a place takes 11 bits
#: A space between white space on both sides: there a text can't be cut safely.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: single marks that the split pattern leaves alone after a word
_MARKS = frozenset("!#$%&()*+,-./:;<=>?@[]^_`{|}~")
#: rank of a pair that is not in the vocabulary; bits of an entry's id and place
_NONE, _IDS, _PLACES = 1_000_000, (1 << 17) - 1, ((1 << 11) - 1) << 17
#: Sizes of the two halves of the rank table (primes).
_N1, _N2 = 121001, 113501


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Byte pieces and their ranks, which are also their ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """(left id << 16 | right id) -> id of the merged piece."""
    out = {}
    for piece, merged in ranks.items():
        for k in range(1, len(piece)):
            left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
            if left is not None and right is not None:
                out[left << 16 | right] = merged
    return out


def rank_table(pairs: dict[int, int]) -> np.ndarray:
    """Cuckoo table: a pair is at ``key % N1`` or at ``N1 + key % N2``, as
    ``key << 17 | id``; -1 where nothing is."""
    table = [-1] * (_N1 + _N2)
    for key, merged in pairs.items():
        entry, at = key << 17 | merged, key % _N1
        for _ in range(5000):
            entry, table[at] = table[at], entry
            if entry < 0:
                break
            k = entry >> 17
            at = _N1 + k % _N2 if at == k % _N1 else k % _N1
        else:
            raise ValueError("the vocabulary has too many pairs for the table")
    return np.array(table, dtype=np.int64)


def _literal(values, kind: str) -> Column:
    """A long array as one folded literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def merge_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """For an array of words, each as ``spell`` writes it: the words merged, entry by
    entry; the low bits (``_IDS``) of the entries are the token ids."""
    table = _literal(rank_table(pair_ranks(ranks)), "bigint")
    # bound once as a lambda's argument: the literal stands in the plan a single time
    return F.get(F.transform(F.array(table), lambda t: _merge_with(t, words)), F.lit(0))


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` worked out once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _merge_with(table: Column, words: Column) -> Column:
    """A word being merged is an array of ``rank << 28 | place << 17 | id``: the rank of
    the pair that a piece makes with the next one, the piece's first byte, its id.
    The least entry is the next merge, leftmost first; its rank is the new id."""
    long = lambda n: F.lit(n).cast("bigint")
    n1, n2, ids, places, none = long(_N1), long(_N2), long(_IDS), long(_PLACES), long(_NONE << 28)

    def look(key: Column) -> Column:
        """Rank of a pair of ids, shifted to its place in an entry."""
        second = lambda b: F.when(F.shiftright(b, 17) == key, F.shiftleft(b.bitwiseAND(ids), 28)).otherwise(none)
        return _let(F.get(table, F.pmod(key, n1).cast("int")), lambda a: F.when(
            F.shiftright(a, 17) == key, F.shiftleft(a.bitwiseAND(ids), 28)).otherwise(_let(F.get(table, (F.pmod(key, n2) + n1).cast("int")), second)))

    def entry(left: Column, right: Column, kept: Column) -> Column:
        return _let(F.shiftleft(left, 16).bitwiseOR(right), look).bitwiseOR(kept)

    def merge(state: Column, least: Column) -> Column:
        new = F.shiftright(least, 28)

        def each(e: Column, i: Column) -> Column:
            after = F.get(state, i + 2)
            merged = least.bitwiseAND(places).bitwiseOR(new)
            return (F.when(e == least, F.when(after.isNull(), none.bitwiseOR(merged)).otherwise(entry(new, after.bitwiseAND(ids), merged)))
                    .when(F.get(state, i + 1) == least, entry(e.bitwiseAND(ids), new, e.bitwiseAND(long(_PLACES | _IDS))))
                    .when(F.get(state, i - 1) == least, long(-1)).otherwise(e))

        return F.filter(F.transform(state, each), lambda e: e >= 0)

    def step(state: Column, _: Column) -> Column:
        return _let(F.array_min(state), lambda least: F.when(least < none, merge(state, least)).otherwise(state))

    def word(w: Column) -> Column:
        return F.when(F.size(w) < 2, w).otherwise(F.aggregate(F.sequence(F.lit(2), F.size(w)), w, step))

    return F.transform(words, word)


def byte_tables(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the bytes, and ranks of the pairs of bytes."""
    pairs = np.full((256, 256), _NONE, dtype=np.int64)
    for piece, i in ranks.items():
        if len(piece) == 2:
            pairs[piece[0], piece[1]] = i
    return np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64), pairs


def spell(words: list[bytes], byte_ids: np.ndarray, pairs: np.ndarray) -> pa.ListArray:
    """Each word as the array that ``merge_words`` folds: its bytes' ids, places and ranks of neighbouring pairs."""
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    starts = np.r_[0, ends]
    rank = np.full(len(raw), _NONE, dtype=np.int64)
    rank[:-1] = pairs[raw[:-1], raw[1:]]
    rank[ends[np.diff(starts) > 0] - 1] = _NONE  # a word's last byte has no next one
    place = np.arange(len(raw)) - np.repeat(starts[:-1], np.diff(starts))
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(rank << 28 | place << 17 | byte_ids[raw]))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranked merges of one long word, with a heap of its pairs."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(word[i:end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, z = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != z:
            continue
        alive[j], end[i], after[i] = False, z, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i:end[i]]] for i in range(n) if alive[i]]


class _Memory(dict):
    """Remembers what ``make`` gave for a key."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        found = self[key] = self.make(key)
        return found


class _Cutter:
    """Numbers of the words of texts, and the words not numbered before.

    The pattern begins a new word at every single space, so a text is cut there into units
    and each distinct unit is split into words once.
    """

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.new: list[str] = []
        self.words = _Memory(self._number)
        self.units = _Memory(self._unit)

    def _number(self, word: str) -> bytes:
        self.new.append(word)
        return len(self.words).to_bytes(4, "little")

    def _unit(self, unit: str) -> bytes:
        if unit.isalpha():  # the two usual shapes, without the pattern: a word, and a word with a mark after it
            return self.words[" " + unit]
        if unit[-1:] in _MARKS and unit[:-1].isalpha():
            return self.words[" " + unit[:-1]] + self.words[unit[-1]]
        return self._whole(" " + unit)

    def _whole(self, text: str) -> bytes:
        return b"".join([self.words[w] for w in self.find(text)])

    def numbers(self, text: str | None) -> bytes:
        """Word numbers as little-endian 32-bit integers."""
        if not text:
            return b""
        if _UNSAFE.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        return self._whole(first) + b"".join(map(self.units.__getitem__, rest))


def _pack(x: np.ndarray) -> bytes:
    """32-bit integers, compressed byte plane by byte plane."""
    return zstandard.ZstdCompressor(3).compress(np.asarray(x).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def _pack_words(words: list[bytes]) -> bytes:
    sizes = _pack(np.array([len(w) for w in words], dtype=np.int64))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(3).compress(b"".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    raw = zstandard.ZstdDecompressor().decompress(data[4 + n:])
    ends = np.cumsum(_unpack(data[4:4 + n])).tolist()
    return [raw[a:z] for a, z in zip([0, *ends], ends)]


def _n_words(data: bytes) -> int:
    """How many words ``_pack_words`` has packed."""
    return len(_unpack(data[4:4 + int.from_bytes(data[:4], "little")]))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of several runs, one after another."""
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(int(sizes.sum()))


_SENT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("numbers", pa.binary()), ("words", pa.binary())])
_ASKED = pa.schema([("words", pa.list_(pa.list_(pa.int64()))), ("long", pa.list_(pa.binary())), ("chunks", pa.list_(pa.int64())),
                    ("numbers", pa.list_(pa.binary())), ("places", pa.list_(pa.binary()))])
_TOLD = pa.schema([("chunk", pa.int64()), ("numbers", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())])


def _send_words(n_buckets: int):
    """The words of a chunk, dealt by their crc32."""

    def send(table: pa.Table) -> pa.Table:
        words, rows = _unpack_words(table.column("words")[0].as_py()), []
        bucket = np.array([zlib.crc32(w) % n_buckets for w in words], dtype=np.int64)
        order = np.argsort(bucket, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            rows.append({"bucket": int(bucket[own[0]]), "chunk": table.column("chunk")[0].as_py(), "numbers": _pack(own),
                         "words": _pack_words([words[i] for i in own.tolist()])})
        out = pa.Table.from_pylist(rows, schema=_SENT)
        del words, rows
        release()
        return out

    return send


def _distinct_words(byte_ids: np.ndarray, byte_pairs: np.ndarray):
    """One row per bucket: its distinct words, ready to be merged, and who asked for which."""

    def gather(table: pa.Table) -> pa.Table:
        place: dict[bytes, int] = {}
        places = [_pack(np.array([place.setdefault(w, len(place)) for w in _unpack_words(x)], dtype=np.int64))
                  for x in table.column("words").to_pylist()]
        flat = spell([w if len(w) <= LONG_WORD else b"" for w in place], byte_ids, byte_pairs)
        return pa.Table.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat),
             pa.array([[w for w in place if len(w) > LONG_WORD]], pa.list_(pa.binary())), pa.array([table.column("chunk").to_pylist()], pa.list_(pa.int64())),
             pa.array([table.column("numbers").to_pylist()], pa.list_(pa.binary())), pa.array([places], pa.list_(pa.binary()))], schema=_ASKED)

    return gather


def _answer(ranks: dict[bytes, int]):
    """The ids of a bucket's words, to the chunks that asked."""

    def answer(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                found = row.column("words").flatten()
                ends = found.offsets.to_numpy().astype(np.int64) - found.offsets[0].as_py()
                ids, sizes, starts = found.flatten().to_numpy() & _IDS, np.diff(ends), ends[:-1]
                if not sizes.all():  # long words come merged by themselves
                    more = [merge_long(w, ranks) for w in row.column("long")[0].as_py()]
                    at, extra = np.flatnonzero(sizes == 0), np.array([len(m) for m in more])
                    starts, sizes = starts.copy(), sizes.copy()
                    starts[at] = len(ids) + np.r_[0, np.cumsum(extra)[:-1]]
                    sizes[at] = extra
                    ids = np.concatenate([ids, *[np.array(m, dtype=np.int64) for m in more]])
                rows = []
                for chunk, numbers, places in zip(*(row.column(c)[0].as_py() for c in ("chunks", "numbers", "places"))):
                    own = _unpack(places)
                    rows.append({"chunk": chunk, "numbers": numbers, "sizes": _pack(sizes[own]), "ids": _pack(ids[_runs(starts[own], sizes[own])])})
                yield pa.RecordBatch.from_pylist(rows, schema=_TOLD)
            release()

    return answer


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
           carry: list[str] = (), words: int = WORDS, as_ids: bool = False) -> DataFrame:
    """carried (struct of the ``carry`` columns), n_tokens, ids_text (decimal ids joined by commas), decoded (bytes) of every row.

    With ``as_ids`` token_ids (an array of int) and decoded as text take the place of the last two.
    A null text is empty: no ids.  The split pattern's words are encoded one by
    one, without special tokens.  An empty table gives no rows.
    """
    byte_ids, byte_pairs = byte_tables(ranks)
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    kept = docs.select(carried.alias("carried"), F.col(text_col).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    own_type = to_arrow_type(_nullable(kept.schema["carried"].dataType))
    own_ddl = kept.schema["carried"].dataType.simpleString()
    n_buckets = 4 * n_groups(docs, text_col, chunk_bytes)

    def cut(batches):
        part, number = TaskContext.get().partitionId(), 0
        cutter = _Cutter(pattern)
        rows: list = []
        texts: list[bytes] = []
        size = 0

        def flush():
            nonlocal rows, texts, size, number
            spelt = [w.encode() for w in cutter.new]
            own = pa.concat_arrays(rows)
            listed = _pack_words(spelt)
            # named after its words: ids can't meet a chunk that a repeated task has cut differently
            name = hashlib.blake2b(listed + f"{part}/{number}".encode(), digest_size=8).digest()
            out = pa.RecordBatch.from_arrays(
                [pa.array([int.from_bytes(name, "little", signed=True)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                 pa.array([_pack(np.array([len(t) // 4 for t in texts]))]), pa.array([_pack(np.frombuffer(b"".join(texts), dtype="<u4"))]),
                 pa.array([listed])], ["chunk", "carried", "sizes", "numbers", "words"])
            cutter.forget()
            rows, texts, size, number = [], [], 0, number + 1
            release()
            return out

        for b in batches:
            for a in range(0, b.num_rows, 256):
                some = b.slice(a, 256)
                rows.append(some.column("carried").cast(own_type))
                for t in some.column("text").to_pylist():
                    texts.append(cutter.numbers(t))
                size += some.column("text").nbytes
                if size >= chunk_bytes or len(cutter.words) > words:
                    yield flush()
        if rows:
            yield flush()

    kinds = (pa.list_(pa.int32()), pa.string()) if as_ids else (pa.string(), pa.binary())
    done = pa.schema([("carried", own_type), ("n_tokens", pa.int64()), ("token_ids" if as_ids else "ids_text", kinds[0]), ("decoded", kinds[1])])

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        """The texts of a chunk, in batches of a few: Spark holds a batch whole."""
        if not left.num_rows:
            return done.empty_table()
        n = _n_words(left.column("words")[0].as_py())
        spelt: list = [""] * n
        raw: list = [b""] * n
        start, count = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        flats, at = [np.zeros(0, dtype=np.int32)], 0
        for numbers, sizes, ids in zip(*(right.column(c) for c in ("numbers", "sizes", "ids"))):
            own, size, flat = _unpack(numbers.as_py()), _unpack(sizes.as_py()), _unpack(ids.as_py())
            ends = np.cumsum(size)
            start[own], count[own], at = at + ends - size, size, at + len(flat)
            each = flat.tolist()
            for k, a, z in zip(own.tolist(), (ends - size).tolist(), ends.tolist()):
                raw[k] = b"".join([pieces[i] for i in each[a:z]])
                if not as_ids:
                    spelt[k] = ",".join(map(str, each[a:z]))
            if as_ids:
                flats.append(flat.astype(np.int32))
        if not count.all():
            raise RuntimeError("ids of some words are missing: a chunk was cut anew after its words had been sent")
        flat = np.concatenate(flats)
        del flats
        numbers = _unpack(left.column("numbers")[0].as_py())
        ends = np.r_[0, np.cumsum(_unpack(left.column("sizes")[0].as_py()))]
        carried = left.column("carried").combine_chunks().flatten()
        out = []
        for first in range(0, len(carried), BATCH_ROWS):
            cut = ends[first:first + BATCH_ROWS + 1]
            own = numbers[cut[0]:cut[-1]]
            total = np.r_[0, np.cumsum(count[own])][cut - cut[0]]
            each = [own[a:z].tolist() for a, z in zip(cut[:-1] - cut[0], cut[1:] - cut[0])]
            if as_ids:
                ids = pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(flat[_runs(start[own], count[own])]))
            else:
                ids = pa.array([",".join([spelt[k] for k in words]) for words in each], pa.string())
            texts = pa.array([b"".join([raw[k] for k in words]) for words in each], pa.binary())
            out.append(pa.RecordBatch.from_arrays([carried.slice(first, len(each)), pa.array(np.diff(total)), ids, texts.cast(kinds[1])], schema=done))
        del spelt, raw, numbers
        release()
        return pa.Table.from_batches(out, done)

    chunks = kept.mapInArrow(cut, f"chunk long, carried array<{own_ddl}>, sizes binary, numbers binary, words binary").groupBy("chunk")
    sent = chunks.applyInArrow(_send_words(n_buckets), "bucket long, chunk long, numbers binary, words binary")
    asked = sent.groupBy("bucket").applyInArrow(
        _distinct_words(byte_ids, byte_pairs), "words array<array<bigint>>, long array<binary>, chunks array<bigint>, numbers array<binary>, places array<binary>")
    told = asked.withColumn("words", merge_words(F.col("words"), ranks)).mapInArrow(
        _answer(ranks), "chunk long, numbers binary, sizes binary, ids binary")
    return chunks.cogroup(told.groupBy("chunk")).applyInArrow(
        put_together, f"carried {own_ddl}, n_tokens long, " + ("token_ids array<int>, decoded string" if as_ids else "ids_text string, decoded binary"))


def _nullable(kind: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType, True) for f in kind.fields])
