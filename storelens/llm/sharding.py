"""Histogram sort into shards of near-equal bytes.

The sort key is (64-bit hash of the text, doc_id, row number), written as 24
bytes that compare like the triple.  Equal texts are therefore neighbours and
stay in one shard unless they straddle a boundary by more than the group
tolerance.  Splitters are found by counting: each round counts, in every
partition, the exact bytes and rows between the candidate boundaries (probes),
then places new probes inside the one interval that still holds each target.
Only counts travel; when all splitters are settled, rows are exchanged once.

Between the shard boundaries there are inner splitters, one per
``rows_per_range`` rows, so that no task sorts more than that many rows
whatever the table size, and a hot text is split by (doc_id, row number).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm.common import checkpointed, text_bytes

KEY_BYTES = 24
_TOP = 1 << (8 * KEY_BYTES)
_TEXT_STEP = 1 << 128  # one step of the text hash


def _be(column) -> "F.Column":
    """A long as 8 bytes that compare like the number (sign bit flipped)."""
    flipped = column.bitwiseXOR(F.lit(-(1 << 63)))
    return F.unhex(F.lpad(F.hex(flipped), 16, "0"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the 24-byte sort key of every row.

    A null text has size 1 and the crc of no bytes; a null id sorts as the
    smallest long.  Repeated rows differ by their row number.
    """
    text = F.col(text_col)
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (text_bytes(text) + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.concat(_be(F.xxhash64(raw)), _be(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))),
                 _be(F.monotonically_increasing_id())).alias("key"))


def _as_int(key: bytes) -> int:
    return int.from_bytes(key, "big")


def _as_keys(values: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(v.to_bytes(KEY_BYTES, "big") for v in values), dtype=f"S{KEY_BYTES}")


def _keys_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The 24-byte keys of an Arrow binary column as a numpy string array."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(flat.to_pylist()), dtype=f"S{KEY_BYTES}") if len(flat) else np.zeros(0, f"S{KEY_BYTES}")


def _histogram(rows: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Interval number -> (bytes, rows, least key, greatest key) between probes."""
    at = _as_keys(probes)

    def count(batches):
        for b in batches:
            if not b.num_rows:
                continue
            keys = _keys_of(b.column("key"))
            size = b.column("size").to_numpy()
            order = np.argsort(keys, kind="stable")
            keys, size = keys[order], size[order]
            where = np.searchsorted(at, keys, side="right")
            first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
            last = np.r_[first[1:], len(keys)] - 1
            pad = lambda k: bytes(k).ljust(KEY_BYTES, b"\0")  # noqa: E731  numpy strips trailing zero bytes
            yield pa.RecordBatch.from_arrays(
                [pa.array(where[first].astype("int32")), pa.array(np.add.reduceat(size, first)),
                 pa.array((last - first + 1).astype("int64")),
                 pa.array([pad(k) for k in keys[first]], pa.binary()),
                 pa.array([pad(k) for k in keys[last]], pa.binary())], ["i", "b", "n", "lo", "hi"])

    found = (rows.select("key", "size").mapInArrow(count, "i int, b long, n long, lo binary, hi binary")
             .groupBy("i").agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    return {r["i"]: (r["b"], r["n"], _as_int(bytes(r["lo"])), _as_int(bytes(r["hi"]))) for r in found.collect()}


def find_splitters(rows: DataFrame, n_ranges: int, coarse_every: int, tolerance: float = 0.001,
                   group_tolerance: float = 0.005, probes_per_target: int = 24) -> list[tuple[int, int, int]]:
    """(key, bytes below, rows below) of the ``n_ranges - 1`` splitters.

    Every ``coarse_every``-th is a shard boundary, held to ``tolerance`` of a
    shard's bytes; the others only bound the work of a task and take the
    nearest probe of the same rounds.  Each round narrows an interval
    to the keys really in it, so a hot text is resolved to its ids at once.
    """
    whole = _histogram(rows, [])
    if not whole:
        return []
    total, n_rows, least, greatest = whole[0]
    wanted = [total * k / n_ranges for k in range(1, n_ranges)]
    slack = tolerance * total / n_ranges * coarse_every
    slack_group = group_tolerance * total / n_ranges * coarse_every
    # what is known: sorted boundaries (key, bytes below, rows below) and, between neighbours, the range of keys
    settled: list[tuple[int, int, int] | None] = [None] * len(wanted)
    brackets = [(least, greatest, 0, total, 0, n_rows)] * len(wanted)  # least key, greatest key, bytes below and up to, rows below and up to
    while any(s is None for s in settled):
        by_bracket: dict[tuple, list[int]] = {}
        for t, s in enumerate(settled):
            if s is None:
                by_bracket.setdefault(brackets[t], []).append(t)
        probes: set[int] = set()
        for (lo, hi, *_), targets in by_bracket.items():
            n = probes_per_target * len(targets)
            one_text = lo // _TEXT_STEP == hi // _TEXT_STEP
            for k in range(1, n + 1):
                p = lo + (hi - lo) * k // (n + 1) + 1
                probes.add(p if one_text else min((p // _TEXT_STEP + 1) * _TEXT_STEP, _TOP - 1))
            probes.update((lo, hi + 1 if hi + 1 < _TOP else hi))
            if not one_text:  # keep the first and last text of the interval apart from the rest
                probes.update(((lo // _TEXT_STEP + 1) * _TEXT_STEP, hi // _TEXT_STEP * _TEXT_STEP))
        at = sorted(probes)
        seen = _histogram(rows, at)
        below_b, below_n, known, cells = 0, 0, [], []
        for i in range(len(at) + 1):
            b, n, lo, hi = seen.get(i, (0, 0, 0, 0))
            if i:
                known.append((at[i - 1], below_b, below_n))
            if n:
                cells.append((lo, hi, below_b, below_b + b, below_n, below_n + n))
            below_b, below_n = below_b + b, below_n + n
        known_bytes = np.array([k[1] for k in known], dtype=np.float64)
        ends = np.array([c[3] for c in cells], dtype=np.float64)
        for t, s in enumerate(settled):
            if s is not None:
                continue
            near = known[int(np.argmin(np.abs(known_bytes - wanted[t])))]
            cell = cells[min(int(np.searchsorted(ends, wanted[t], side="left")), len(cells) - 1)]
            coarse = (t + 1) % coarse_every == 0
            lo, hi, b0, b1, r0, r1 = cell
            edge = min(((lo, b0, r0), (hi + 1, b1, r1)), key=lambda e: abs(e[1] - wanted[t]))
            single = r1 - r0 <= 1
            one_text = lo // _TEXT_STEP == hi // _TEXT_STEP
            if abs(near[1] - wanted[t]) <= (slack if coarse else 25 * slack):
                settled[t] = near
            elif single or (one_text and abs(edge[1] - wanted[t]) <= slack_group):
                settled[t] = edge
            else:
                brackets[t] = cell
    return settled


def histogram_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                     tolerance: float = 0.001, group_tolerance: float = 0.005,
                     rows_per_range: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row: shards of near-equal bytes in key order.

    Slots count from 0 without gaps inside each shard.  An empty table gives no
    rows; with fewer rows than shards some shards stay empty.
    """
    rows = checkpointed(keyed(docs, id_col, text_col))
    n_rows = rows.count()
    inner = max(1, -(-n_rows // (n_shards * rows_per_range)))
    splits = find_splitters(rows, n_shards * inner, inner, tolerance, group_tolerance)
    # splitters are ascending; equal ones leave the ranges between them empty
    splits = list(np.maximum.accumulate([s[0] for s in splits])) if splits else []
    by_key = {}
    if splits:
        hist = _histogram(rows, sorted(set(splits)))
        below = 0
        for i, key in enumerate(sorted(set(splits))):
            below += hist.get(i, (0, 0, 0, 0))[1]
            by_key[key] = below
    starts = [0] + [by_key[s] for s in splits]
    shard_start = np.array([starts[r - r % inner] if splits else 0 for r in range(n_shards * inner)], dtype=np.int64)
    range_start = np.array([starts[r] if splits else 0 for r in range(n_shards * inner)], dtype=np.int64)
    at = _as_keys([int(s) for s in splits])

    def place(batches):
        for b in batches:
            where = np.searchsorted(at, _keys_of(b.column("key")), side="right")
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(where.astype("int32")), pa.array((where // inner).astype("int32")),
                 pa.array(range_start[where] - shard_start[where])],
                [*b.schema.names, "range", "shard", "range_slot"])

    placed = rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, key binary, range int, shard int, range_slot long")
    order = Window.partitionBy("range").orderBy("key")
    return placed.select("doc_id", "size", "text_crc32", "shard",
                         (F.col("range_slot") + F.row_number().over(order) - 1).cast("long").alias("slot"))
