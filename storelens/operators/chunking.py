"""Recursive chunking of document texts (V1, V2).

Contract (the splitter's own code is not part of the reference, so this is
our statement of it): take the first separator present in the text; cut
before each occurrence so the separator starts the next piece; pieces of
``size`` or more are cut again with the remaining separators (a piece with no
separator left stays whole); runs of smaller neighbours are merged up to
``size``; each new chunk restarts with whole trailing pieces totalling at most
``overlap``, fewer if the next piece would not fit.  Nothing is trimmed, so
``[start, end)`` offsets (code points) tile the text.

The work is a per-document Python loop over spans run inside
``mapInArrow``: documents stay in their scan partitions, nothing shuffles.  A task
cuts and gives out STEP_BYTES of text at a time, however many rows a batch has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Fixed values from the reference index build: separators in order, chunk
# size and overlap (characters).
SEPARATORS = ["\n§", "§", "\n\n", "\n", ".", " "]
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
#: UTF-8 bytes of text that are cut at once (one larger text is cut alone).
STEP_BYTES = 1 << 20


def _pieces(text: str, lo: int, hi: int, sep: str) -> list[tuple[int, int]]:
    """Cut [lo, hi) before every occurrence of ``sep`` (non-overlapping)."""
    cuts = [lo]
    pos = text.find(sep, lo, hi)
    while pos != -1:
        if pos + len(sep) > hi:
            break
        cuts.append(pos)
        pos = text.find(sep, pos + len(sep), hi)
    cuts.append(hi)
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _merge(run: list[tuple[int, int]], size: int, overlap: int) -> list[tuple[int, int]]:
    """Merge adjacent small spans into chunks of at most ``size`` with a
    trailing-piece overlap of at most ``overlap``."""
    out: list[tuple[int, int]] = []
    window: list[tuple[int, int]] = []
    total = 0
    for s, e in run:
        n = e - s
        if window and total + n > size:
            out.append((window[0][0], window[-1][1]))
            while window and (total > overlap or total + n > size):
                total -= window[0][1] - window[0][0]
                window.pop(0)
        window.append((s, e))
        total += n
    if window:
        out.append((window[0][0], window[-1][1]))
    return out


def split_spans(text: str, separators: Sequence[str] = SEPARATORS, size: int = CHUNK_SIZE,
                overlap: int = CHUNK_OVERLAP, lo: int = 0, hi: int | None = None) -> list[tuple[int, int]]:
    """Chunk spans of ``text[lo:hi]`` under the contract above."""
    hi = len(text) if hi is None else hi
    if hi <= lo:
        return []
    sep, rest = None, []
    for i, s in enumerate(separators):
        if text.find(s, lo, hi) != -1:
            sep, rest = s, list(separators[i + 1:])
            break
    pieces = [(lo, hi)] if sep is None else _pieces(text, lo, hi, sep)
    out: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []
    for s, e in pieces:
        if e - s < size:
            run.append((s, e))
            continue
        if run:
            out.extend(_merge(run, size, overlap))
            run = []
        if rest:
            out.extend(split_spans(text, rest, size, overlap, s, e))
        else:
            out.append((s, e))
    if run:
        out.extend(_merge(run, size, overlap))
    return out


def byte_slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` whose texts take at most ``most`` bytes together, or one row that takes more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, z - a)
        a = z


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    separators: Sequence[str] = SEPARATORS, size: int = CHUNK_SIZE,
                    overlap: int = CHUNK_OVERLAP, carry: Sequence[str] = (),
                    with_length: bool = False) -> DataFrame:
    """V1/V2: one row per chunk ``(id, chunk_no, start, end, chunk_text, *carry)``.

    ``carry`` columns of the document are copied onto each of its chunks in
    the same pass (no join back); ``with_length`` adds the document's length
    (``doc_len``).  Empty or null texts yield no chunk.
    """
    carry = list(carry)
    src = docs.select(id_col, text_col, *carry)
    fields = [src.schema[id_col],
              StructField("chunk_no", LongType()), StructField("start", LongType()),
              StructField("end", LongType()), StructField("chunk_text", StringType())]
    fields += [src.schema[c] for c in carry]
    if with_length:
        fields.append(StructField("doc_len", LongType()))
    schema = StructType(fields)
    seps = list(separators)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, 1, STEP_BYTES):
                owner, no, start, end, cut, length = [], [], [], [], [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    if not isinstance(text, str) or not text:
                        continue
                    spans = split_spans(text, seps, size, overlap)
                    owner += [i] * len(spans)
                    no += range(len(spans))
                    start += [s for s, _ in spans]
                    end += [e for _, e in spans]
                    cut += [text[s:e] for s, e in spans]
                    length += [len(text)] * len(spans)
                of = pa.array(owner, pa.int64())
                numbers = [pa.array(x, pa.int64()) for x in (no, start, end)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(of), *numbers, pa.array(cut, pa.string()), *[b.column(2 + i).take(of) for i in range(len(carry))],
                     *([pa.array(length, pa.int64())] if with_length else [])], schema.fieldNames())

    return src.mapInArrow(run, schema)


def chunk_invariants(chunks: DataFrame, docs: DataFrame | None = None, id_col: str = "doc_id",
                     text_col: str = "text",
                     size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                     separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """Per document: covered length and the tiling / size / overlap checks.

    The document length comes from the chunks' ``doc_len`` when present (no
    second read of the texts), else from ``docs``."""
    from pyspark.sql import Window

    w = Window.partitionBy(id_col).orderBy("chunk_no")
    c = chunks.withColumn("__prev_end", F.lag("end").over(w))
    no_sep = None
    # a chunk that can't be split further may begin with the separator before it
    body = F.substring("chunk_text", 2, 1 << 30)
    for s in separators:
        term = ~F.when(F.lit(len(s) == 1) & F.col("chunk_text").startswith(s), body).otherwise(F.col("chunk_text")).contains(s)
        no_sep = term if no_sep is None else (no_sep & term)
    per_doc = c.groupBy(id_col).agg(
        F.sum(F.col("end") - F.greatest("start", F.coalesce("__prev_end", "start"))).alias("covered"),
        (F.min("start") == 0).alias("starts_at_zero"),
        F.max("end").alias("__max_end"),
        *([F.max("doc_len").alias("__len")] if "doc_len" in chunks.columns else []),
        F.coalesce(F.bool_and(F.col("start") <= F.col("__prev_end")), F.lit(True)).alias("no_gap"),
        F.coalesce(F.bool_and(F.col("__prev_end") - F.col("start") <= overlap), F.lit(True)).alias("overlap_ok"),
        F.bool_and((F.col("end") - F.col("start") <= size) | no_sep).alias("size_ok"))
    if "doc_len" not in chunks.columns:
        lengths = docs.select(id_col, F.length(text_col).cast("long").alias("__len"))
        per_doc = per_doc.join(lengths, id_col)
    return per_doc.select(
        id_col, "covered", "starts_at_zero", (F.col("__max_end") == F.col("__len")).alias("ends_at_length"),
        "no_gap", "overlap_ok", "size_ok")
