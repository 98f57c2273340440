"""Token ids of documents, written to patched frame-of-reference files and read back.

Documents are range-partitioned by id; each task encodes its documents in
ascending id order and writes files of a bounded number of ids to the shared
folder.  A file appears under its name only when it is whole, and the list of
files is made from the results of the tasks that succeeded, so a lost executor
or a repeated task leaves nothing that a reader would take for data.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storelens.llm.common import checkpointed, n_groups, quiet_threads, shared_folder, tokenizer_file
from storelens.llm.patched_frames import decode_blocks, read_index, write_file

END_ID = 0
#: Text per task and ids per file.
TASK_BYTES, FILE_IDS = 32 << 20, 4 << 20
#: Distinct words whose ids a task remembers before it starts afresh.
CACHE_WORDS = 600_000

#: A space between white space on both sides: there a text can't be cut safely.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: single marks that the split pattern leaves alone after a word
_MARKS = frozenset("!#$%&()*+,-./:;<=>?@[]^_`{|}~")
_ENCODERS: dict = {}


class _Memory(dict):
    """Remembers what ``make`` gave for a key."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        found = self[key] = self.make(key)
        return found

    def trim(self, most: int) -> None:
        if len(self) > most:
            for key in list(self)[most // 2:]:
                del self[key]


class WordEncoder:
    """``Tokenizer.encode`` of whole texts, with the ids of words remembered.

    The tokenizer splits a text by a pattern and merges every piece by itself.  The
    pattern begins a new piece at every single space, so a text is cut there into units
    whose ids are remembered; a new unit is split by the same pattern, and a new
    piece goes to the tokenizer's own model.  Texts with longer runs of white
    space are not cut first.  When the memory is full, its oldest entries,
    mostly the frequent words, stay.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        quiet_threads()
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if not isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) or self.tokenizer.normalizer is not None:
            raise ValueError("a byte-level vocabulary without normalisation is needed")
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        # the vocabulary's letters for bytes: printable ones stand for themselves, the rest follow from 256 on
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: 256 + k for k, b in enumerate(rest)}
        self.pieces = _Memory(self._piece)
        self.units = _Memory(self._unit)
        self.cache_words = cache_words

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece[1:].isalpha() and piece[0] == " ":
            spelt = "Ġ" + piece[1:]
        else:
            spelt = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        if unit.isalpha():  # the two usual shapes, without the pattern: a word, and a word with a mark after it
            return self.pieces[" " + unit]
        if unit[-1:] in _MARKS and unit[:-1].isalpha():
            return self.pieces[" " + unit[:-1]] + self.pieces[unit[-1]]
        return self._whole(" " + unit)

    def _whole(self, text: str) -> bytes:
        return b"".join([self.pieces[p] for p in self.split(text)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without any end id."""
        out = []
        for text in texts:
            if any(t in text for t in self.added):  # the library finds these before anything else
                ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            elif _UNSAFE.search(text):
                ids = self._whole(text)
            else:
                first, *rest = text.split(" ")
                ids = self._whole(first) + b"".join(map(self.units.__getitem__, rest))
            out.append(np.frombuffer(ids, dtype="<u4"))
        self.pieces.trim(self.cache_words)
        self.units.trim(self.cache_words)
        return out


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _save(folder: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    hidden = f"{base}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(hidden) as out:
        out.write(data)
    system.move(hidden, f"{base}/{name}")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID, task_bytes: int = TASK_BYTES, file_ids: int = FILE_IDS) -> DataFrame:
    """Write all documents in ascending id order; one row per file: file, part, number, n_docs, n_ids.

    A null text is empty (its end id alone); null ids come first; rows that
    repeat an id are neighbours.  An empty table writes no file.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tasks = n_groups(rows, "text", task_bytes)
    placed = rows.repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id")

    def write(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list = []
        size = 0

        def flush():
            nonlocal ids, held, size, number
            name = f"part-{part:06d}-{number:05d}-{uuid.uuid4().hex[:12]}.pfor"
            _save(folder, name, write_file(ids, held))
            row = pa.RecordBatch.from_pylist([{"file": name, "part": part, "number": number, "n_docs": len(ids), "n_ids": size}], schema=made)
            ids, held, size, number = [], [], 0, number + 1
            return row

        made = pa.schema([("file", pa.string()), ("part", pa.int64()), ("number", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        encoder = _encoder(vocabulary)
        for b in batches:
            for a in range(0, b.num_rows, 512):
                some = b.slice(a, 512)
                for doc_id, found in zip(some.column("doc_id").to_pylist(), encoder.encode(some.column("text").to_pylist())):
                    ids.append(doc_id)
                    held.append(np.append(found, np.uint32(end_id)).astype("<u4"))
                    size += len(held[-1])
                    if size >= file_ids:
                        yield flush()
        if ids:
            yield flush()

    return checkpointed(placed.mapInArrow(write, "file string, part long, number long, n_docs long, n_ids long"))


def read_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the listed files."""

    def decode(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                doc_ids, firsts, starts = read_index(content)
                ids = decode_blocks(content, starts).astype("<u4")
                yield pa.RecordBatch.from_arrays([
                    pa.array([path.rpartition("/")[2]] * len(doc_ids)), pa.array(doc_ids, pa.int64()), pa.array(firsts[:-1]),
                    pa.array(np.diff(firsts)),
                    pa.array([zlib.crc32(ids[a:z].tobytes()) for a, z in zip(firsts[:-1], firsts[1:])], pa.int64())],
                    ["file", "doc_id", "first", "n_tokens", "ids_crc32"])

    found = (spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("path", "content")
             .mapInArrow(decode, "file string, doc_id long, first long, n_tokens long, ids_crc32 long"))
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    begins = files.select(F.col("file").alias("f"), F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))
    return (found.join(begins, F.col("file") == F.col("f"))
            .select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"))


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write ``docs`` as token files below the shared folder and read their documents back."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "token-files")
    files = write_token_files(docs, folder, vocabulary or tokenizer_file("byte_bpe_50k.json"))
    if not files.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, folder, files)
