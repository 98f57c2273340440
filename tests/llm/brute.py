"""Brute-force versions of the operators, over lists of (doc_id, text)."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np


def class_ids(rows, similar, normalised):
    """Near-duplicate classes by comparing all pairs of documents with an id."""
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    texts = {}
    for d, t in rows:
        if d is not None:
            parent.setdefault(d, d)
            texts.setdefault(d, []).append(normalised(t))
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if find(a) != find(b) and any(x == y or similar(x, y) for x in texts[a] for y in texts[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    own = {}
    for d in ids:
        for t in texts[d]:
            own.setdefault(t, find(d))
    return sorted((d, find(d) if d is not None else own.get(normalised(t))) for d, t in rows if d is not None)


def normalised_of(words):
    return b" ".join(words)


def repeats(rows, window=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept) by a table of all windows; null ids come last."""
    rows = sorted(((math.inf if d is None else d, d, (t or "").encode()) for d, t in rows), key=lambda r: r[0])
    first = {}
    for order, _, b in rows:
        for s in range(len(b) - window + 1):
            first.setdefault(b[s:s + window], order)
    out = []
    for order, d, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if first[b[s:s + window]] < order:
                gone[s:s + window] = b"\1" * window
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [None]


def crc_mod(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def base_scores(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    counts = Counter()
    for d, t in rows:
        if crc_mod(d, 5) != 1:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        own = tokens(t)
        score = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        out.append((d, crc_mod(d, 5) == 1, len(own), sum(counts[w] > 0 for w in own), n, score))
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()


def ids_crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
