"""Patched frame-of-reference blocks for token ids, as a binary file.

File layout, little-endian:

    b"PFOR0001"
    blocks, back to back; one block of up to 1024 ids:
        u32 base     least id of the block
        u16 width    bits of a packed offset, the chosen percentile's bit length
        u16 n        ids in the block
        u16 x        exceptions: offsets that need more than width bits
        packed       ceil(n * width / 8) bytes, low bit first, low width bits of each offset
        u16[x]       places of the exceptions
        u32[x]       their whole offsets
    i64[docs]        document ids
    u8[docs]         1 where the document id is known, 0 where it is null
    u64[docs + 1]    first id of each document in this file, then the number of ids
    u64[blocks]      byte offset of each block
    u64 documents, u64 blocks, u64 byte offset of the document ids
    b"PFOREND1"
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
PERCENTILE = 0.98
MAGIC, END = b"PFOR0001", b"PFOREND1"
_HEAD = np.dtype([("base", "<u4"), ("width", "<u2"), ("n", "<u2"), ("x", "<u2")])


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """(blocks, n) offsets -> (blocks, bytes) of width bits each."""
    if not width:
        return np.zeros((len(low), 0), dtype=np.uint8)
    if width == 16:
        return low.astype("<u2").view(np.uint8).reshape(len(low), -1)
    raw = low.astype("<u4").view(np.uint8).reshape(len(low), low.shape[1], 4)
    bits = np.unpackbits(raw, axis=2, bitorder="little")[:, :, :width]
    return np.packbits(bits.reshape(len(low), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    if width == 16:
        return np.ascontiguousarray(packed).view("<u2").astype(np.int64)
    out = np.zeros((len(packed), n, 32), dtype=np.uint8)
    bits = np.unpackbits(packed, axis=1, bitorder="little")[:, :n * width]
    out[:, :, :width] = bits.reshape(len(packed), n, width)
    return np.packbits(out.reshape(len(packed), -1), axis=1, bitorder="little").view("<u4").astype(np.int64)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of a run of ids."""
    ids = np.asarray(ids, dtype=np.int64)
    out: list[bytes] = []
    whole = len(ids) // BLOCK * BLOCK
    step = BLOCK * 256
    parts = [ids[a:min(a + step, whole)].reshape(-1, BLOCK) for a in range(0, whole, step)]
    if whole < len(ids):
        parts.append(ids[whole:].reshape(1, -1))
    for part in parts:
        n = part.shape[1]
        base = part.min(axis=1)
        offset = part - base[:, None]
        at = max(0, int(np.ceil(percentile * n)) - 1)
        width = np.frexp(np.partition(offset, at, axis=1)[:, at].astype(np.float64))[1]  # bit length
        made: list[bytes] = [b""] * len(part)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            own = offset[rows]
            packed = _pack(own & ((1 << int(w)) - 1), int(w))
            over = own >> int(w) > 0
            for r, p, o, v in zip(rows, packed, over, own):
                x = np.flatnonzero(o)
                head = np.array([(base[r], w, n, len(x))], dtype=_HEAD).tobytes()
                made[r] = head + p.tobytes() + x.astype("<u2").tobytes() + v[x].astype("<u4").tobytes()
        out += made
    return out


def decode_block(data: bytes, at: int) -> np.ndarray:
    """Ids of the block that begins at byte ``at``."""
    return decode_blocks(data, np.array([at]))


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks at these byte offsets, in order."""
    raw = np.frombuffer(data, dtype=np.uint8)
    heads = raw[starts[:, None] + np.arange(_HEAD.itemsize)].copy().view(_HEAD).reshape(-1)
    n = heads["n"].astype(np.int64)
    first = np.r_[0, np.cumsum(n)]
    out = np.empty(first[-1], dtype=np.int64)
    shapes = np.stack([n, heads["width"].astype(np.int64)], axis=1)
    for count, width in np.unique(shapes, axis=0):
        rows = np.flatnonzero((shapes == (count, width)).all(axis=1))
        size = -(-int(count) * int(width) // 8)
        for a in range(0, len(rows), 256):
            some = rows[a:a + 256]
            packed = raw[(starts[some] + _HEAD.itemsize)[:, None] + np.arange(size)]
            values = _unpack(packed, int(width), int(count)) if width else np.zeros((len(some), int(count)), dtype=np.int64)
            out[first[some][:, None] + np.arange(int(count))] = values
    body = starts + _HEAD.itemsize + -(-n * heads["width"].astype(np.int64) // 8)
    for r in np.flatnonzero(heads["x"]):
        x, b = int(heads["x"][r]), int(body[r])
        places = np.frombuffer(data, dtype="<u2", count=x, offset=b).astype(np.int64)
        out[first[r] + places] = np.frombuffer(data, dtype="<u4", count=x, offset=b + 2 * x)
    return out + np.repeat(heads["base"].astype(np.int64), n)


def write_file(doc_ids: list, ids: list[np.ndarray], percentile: float = PERCENTILE) -> bytes:
    """The file of these documents' ids."""
    blocks = encode_blocks(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64), percentile)
    starts = len(MAGIC) + np.r_[0, np.cumsum([len(b) for b in blocks])].astype("<u8")
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    return b"".join([
        MAGIC, *blocks, np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), known.tobytes(),
        np.r_[0, np.cumsum([len(i) for i in ids])].astype("<u8").tobytes(), starts[:-1].astype("<u8").tobytes(),
        np.array([len(doc_ids), len(blocks), starts[-1]], dtype="<u8").tobytes(), END])


def read_index(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, first id of each document (and the count), block starts."""
    if data[:len(MAGIC)] != MAGIC or data[-len(END):] != END:
        raise ValueError("not a whole token file")
    docs, blocks, at = (int(v) for v in np.frombuffer(data, dtype="<u8", count=3, offset=len(data) - len(END) - 24))
    ids = np.frombuffer(data, dtype="<i8", count=docs, offset=at).tolist()
    known = np.frombuffer(data, dtype=np.uint8, count=docs, offset=at + 8 * docs)
    firsts = np.frombuffer(data, dtype="<u8", count=docs + 1, offset=at + 9 * docs).astype(np.int64)
    starts = np.frombuffer(data, dtype="<u8", count=blocks, offset=at + 9 * docs + 8 * (docs + 1)).astype(np.int64)
    return [d if k else None for d, k in zip(ids, known)], firsts, starts


def read_document(data: bytes, number: int) -> np.ndarray:
    """Ids of one document of a file: only the blocks that hold it are read."""
    _, firsts, starts = read_index(data)
    a, z = int(firsts[number]), int(firsts[number + 1])
    if a == z:
        return np.zeros(0, dtype=np.int64)
    some = decode_blocks(data, starts[a // BLOCK:-(-z // BLOCK)])
    return some[a % BLOCK:a % BLOCK + z - a]
