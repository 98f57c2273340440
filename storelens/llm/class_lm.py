"""Scores of whole texts under a Brown class-based bigram model.

Words are lower-cased (A-Z) runs of anything but ASCII white space, and every text
ends with one end token.  Texts are grouped into chunks of bounded size, cut into
tokens once.  The passes over the chunks:

1. counts: each chunk sends its distinct words (as 64-bit hashes) with their
   training counts, dealt by hash, and gets back the corpus count of each.  All words
   are counted, over all documents.
2. seeds: the ``CLUSTERED`` most frequent words are clustered by exchange
   (``class_model``) on their bigram counts in all training texts; every other word
   stands there for its shape (length, mark at the end).  The table of bigrams is
   bounded by the number of seeds and shapes, not by the corpus.
3. classes: every other training word, however rare, is put by its neighbours in all
   training texts, dealt by hash, where the likelihood gains most: a learnt class, or, when
   that gains less than naming the class costs, the class of its shape.  Words of no training text have the class of their shape.
4. class bigrams of all training texts under these classes.
5. scores: every text by its words' counts, their classes and the class bigrams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.class_model import ClassModel, Seeds, exchange
from storelens.llm.common import checkpointed, crc_mod, n_groups, release
from storelens.llm.wordhash import U64, blocks, word_hashes

CLUSTERED, CLASSES = 1000, 32
#: shapes of unclustered words: length 1 to 8 bytes and more, with or without an ASCII mark at the end
SHAPES = 16
#: classes that are not clustered: the shapes, then the end of text
FIXED = SHAPES + 1
END = U64(0x456E64)  # hash of the end token
CHUNK_BYTES = 8 << 20
_MARK = np.zeros(256, dtype=bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


class Tokens:
    """Tokens of some texts in order, each text's end included."""

    def __init__(self, texts: list[bytes]):
        parts = [self._some(texts[a:z]) for a, z in blocks(texts)]
        cat = lambda i, kind: np.concatenate([np.zeros(0, kind), *[p[i] for p in parts]])
        self.hash, self.shape, self.n = cat(0, np.uint64), cat(1, np.int64), cat(2, np.int64)
        self.first = np.r_[0, np.cumsum(self.n)][:-1]
        self.text = np.repeat(np.arange(len(texts)), self.n)

    @staticmethod
    def _some(texts: list[bytes]):
        texts = [t.lower() for t in texts]
        hashes, owner, start, length = word_hashes(texts)
        raw = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        mark = _MARK[raw[start + length - 1]] if len(start) else np.zeros(0, dtype=bool)
        shape = np.minimum(length, 8) - 1 + 8 * mark
        n = np.bincount(owner, minlength=len(texts))
        ends = np.cumsum(n)  # an end goes in after each text's words
        return np.insert(hashes, ends, END), np.insert(shape, ends, SHAPES), n + 1


def _bucketed(hashes: np.ndarray, n_buckets: int):
    """Distinct hashes by (bucket, hash), and where each bucket begins."""
    bucket = (hashes % U64(n_buckets)).astype(np.int64)
    order = np.lexsort((hashes, bucket))
    cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    return order, bucket[order], np.r_[cut, len(order)]


_CHUNK = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("training", pa.list_(pa.bool_())), ("sizes", pa.binary()),
                    ("tokens", pa.binary()), ("hashes", pa.binary()), ("shapes", pa.binary())])
_SENT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()), ("shapes", pa.binary())])
_TOLD = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("counts", pa.binary()), ("top_hash", pa.list_(pa.int64())),
                   ("top_count", pa.list_(pa.int64())), ("top_shape", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("n_types", pa.list_(pa.int64()))])
_NEAR = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("shapes", pa.binary()), ("sizes", pa.binary()),
                   ("cells", pa.binary()), ("counts", pa.binary())])
_JOINED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("classes", pa.binary()), ("n_types", pa.list_(pa.int64()))])
_TEXTS = pa.schema([("doc_id", pa.int64()), ("training", pa.bool_()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("up", pa.float64()),
                    ("classes", pa.binary())])
_ROWS = 8192  # words that are placed at once


def _ddl(schema: pa.Schema) -> str:
    names = {"int64": "long", "bool": "boolean", "binary": "binary", "double": "double"}
    kind = lambda t: f"array<{names[str(t.value_type)]}>" if pa.types.is_list(t) else names[str(t)]
    return ", ".join(f"{f.name} {kind(f.type)}" for f in schema)


def _pack(x: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, compressed byte plane by byte plane."""
    return zstandard.ZstdCompressor(1).compress(np.asarray(x).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def _make_chunk(table: pa.Table) -> pa.Table:
    """The texts of a chunk as numbers of its distinct words."""
    tokens = Tokens([t or b"" for t in table.column("raw").to_pylist()])
    hashes, first, back = np.unique(tokens.hash, return_index=True, return_inverse=True)
    out = pa.Table.from_pylist([{
        "chunk": table.column("chunk")[0].as_py(), "doc_ids": table.column("doc_id").to_pylist(), "training": table.column("training").to_pylist(),
        "sizes": _pack(tokens.n), "tokens": _pack(back), "hashes": hashes.astype("<u8").tobytes(),
        "shapes": tokens.shape[first].astype(np.uint8).tobytes()}], schema=_CHUNK)
    del tokens, back
    release()
    return out


class Chunk:
    """A row of ``_make_chunk``: tokens as numbers of the distinct words, which have hashes and shapes."""

    def __init__(self, row: dict):
        self.number, self.doc_ids = row["chunk"], row["doc_ids"]
        self.training = np.array(row["training"], dtype=bool)
        self.n, self.tokens = _unpack(row["sizes"]), _unpack(row["tokens"])
        self.hashes = np.frombuffer(row["hashes"], dtype="<u8")
        self.shapes = np.frombuffer(row["shapes"], dtype=np.uint8).astype(np.int64)
        self.first = np.r_[0, np.cumsum(self.n)][:-1]
        self.taught = np.repeat(self.training, self.n)  # tokens of training texts


def _each(make, schema: pa.Schema):
    """``make`` over the chunks, one at a time; it gives rows of ``schema``."""
    def over(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_pylist(make(Chunk(b.slice(i, 1).to_pylist()[0])), schema=schema)
                release()

    return over


def _send_counts(n_buckets: int):
    def send(c: Chunk) -> list[dict]:
        counts = np.bincount(c.tokens[c.taught], minlength=len(c.hashes))
        order, bucket, cut = _bucketed(c.hashes, n_buckets)
        rows = []
        for a, z in zip(cut[:-1], cut[1:]):
            r = order[a:z]
            rows.append({"bucket": int(bucket[a]), "chunk": c.number, "hashes": c.hashes[r].tobytes(),
                         "counts": counts[r].astype("<u4").tobytes(), "shapes": c.shapes[r].astype(np.uint8).tobytes()})
        return rows

    return send


def _sum_counts(clustered: int):
    def total(table: pa.Table) -> pa.Table:
        """Corpus counts of a bucket's words, back to every chunk that asked; the
        bucket's own sums go with the first row."""
        col = lambda name, kind: [np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()]
        each = col("hashes", "<u8")
        hashes, first, back = np.unique(np.concatenate(each), return_index=True, return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate(col("counts", "<u4")), minlength=len(hashes)).astype(np.int64)
        shapes = np.concatenate(col("shapes", np.uint8))[first].astype(np.int64)
        seen = counts > 0
        words = np.flatnonzero(seen & (shapes < SHAPES))
        top = words[np.lexsort((hashes[words].view(np.int64), -counts[words]))[:clustered]]  # ties as score_texts orders them
        rows, at = [], 0
        bucket = table.column("bucket")[0].as_py()
        for chunk, own in zip(table.column("chunk").to_pylist(), each):
            rows.append({"chunk": chunk, "bucket": bucket, "counts": counts[back[at:at + len(own)]].astype("<i8").tobytes(),
                         "top_hash": None, "top_count": None, "top_shape": None, "n_tokens": None, "n_types": None})
            at += len(own)
        rows[0] |= {"top_hash": hashes[top].view(np.int64).tolist(), "top_count": counts[top].tolist(), "top_shape": shapes[top].tolist(),
                    "n_tokens": np.bincount(shapes, weights=counts, minlength=FIXED).astype(np.int64).tolist(),
                    "n_types": np.bincount(shapes[seen], minlength=FIXED).tolist()}
        return pa.Table.from_pylist(rows, schema=_TOLD)

    return total


_CELLS = pa.schema([("part", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())])


def _bigrams(chunks: DataFrame, words: np.ndarray) -> np.ndarray:
    """Counts of neighbouring items (seeds, shapes, end) in the training texts."""
    n = len(words) + FIXED
    order = np.argsort(words, kind="stable")
    known = words[order]
    per_part = max(1, -(-n // 16)) * n  # sixteen shares of the table

    def count(batches):
        table = np.zeros(n * n, dtype=np.int64)
        for b in batches:
            for i in range(b.num_rows):
                c = Chunk(b.slice(i, 1).to_pylist()[0])
                item = len(words) + c.shapes
                if len(known):
                    at = np.minimum(np.searchsorted(known, c.hashes), len(known) - 1)
                    item = np.where(known[at] == c.hashes, order[at], item)
                item = item[c.tokens]
                before = np.r_[n - 1, item[:-1]]  # a text follows an end, as the one before it has one
                cell, times = np.unique((before * n + item)[c.taught], return_counts=True)
                table[cell] += times
                release()
        cell = np.flatnonzero(table)
        for part in np.unique(cell // per_part):
            own = cell[cell // per_part == part]
            yield pa.RecordBatch.from_pylist([{"part": int(part), "cells": own.astype("<i4").tobytes(), "counts": table[own].astype("<i8").tobytes()}], schema=_CELLS)

    def add(table: pa.Table) -> pa.Table:
        cells = np.concatenate([np.frombuffer(x, dtype="<i4") for x in table.column("cells").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, dtype="<i8") for x in table.column("counts").to_pylist()])
        found, back = np.unique(cells, return_inverse=True)
        total = np.bincount(back, weights=counts).astype("<i8")
        return pa.Table.from_pylist([{"part": table.column("part")[0].as_py(), "cells": found.astype("<i4").tobytes(), "counts": total.tobytes()}], schema=_CELLS)

    ddl = "part long, cells binary, counts binary"
    sums = chunks.mapInArrow(count, ddl).groupBy("part").applyInArrow(add, ddl)
    out = np.zeros(n * n)
    for r in sums.collect():  # at most n * n cells, whatever the corpus
        out[np.frombuffer(r["cells"], dtype="<i4")] = np.frombuffer(r["counts"], dtype="<i8")
    return out.reshape(n, n)


def _send_neighbours(n_buckets: int, seeds: Seeds):
    """For each word of a chunk that is no seed, how often each class stands before and after it in training texts."""
    width = 2 * seeds.total

    def send(c: Chunk) -> list[dict]:
        order, bucket, cut = _bucketed(c.hashes, n_buckets)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        own = seeds.classes_of(c.hashes, c.shapes)
        rest = (own >= seeds.first_rest) & (own < seeds.total - 1)
        at = np.flatnonzero(rest[c.tokens] & c.taught)  # never the last token, which is an end
        word, own = rank[c.tokens[at]], own[c.tokens]
        before = np.where(at > 0, own[at - 1], seeds.total - 1)
        cell, count = np.unique(np.r_[word * width + before, word * width + seeds.total + own[np.minimum(at + 1, len(own) - 1)]], return_counts=True)
        sizes = np.bincount(cell // width, minlength=len(order))
        ends = np.r_[0, np.cumsum(sizes)]
        return [{"bucket": int(bucket[a]), "chunk": c.number, "hashes": c.hashes[order[a:z]].tobytes(), "shapes": c.shapes[order[a:z]].astype(np.uint8).tobytes(),
                 "sizes": _pack(sizes[a:z]), "cells": _pack(cell[ends[a]:ends[z]] % width), "counts": _pack(count[ends[a]:ends[z]])}
                for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())]

    return send


def _place_words(seeds: Seeds):
    width = 2 * seeds.total

    def place(table: pa.Table) -> pa.Table:
        """Classes of a bucket's words, to every chunk that holds them."""
        col = lambda name, read: [read(x.as_py()) for x in table.column(name)]
        each = col("hashes", lambda x: np.frombuffer(x, dtype="<u8"))
        hashes, first, back = np.unique(np.concatenate(each), return_index=True, return_inverse=True)
        shapes = np.concatenate(col("shapes", lambda x: np.frombuffer(x, dtype=np.uint8)))[first].astype(np.int64)
        word = np.repeat(back, np.concatenate(col("sizes", _unpack)))
        key, counts = word * width + np.concatenate(col("cells", _unpack)), np.concatenate(col("counts", _unpack))
        del word
        order = np.argsort(key, kind="stable")
        key, counts = key[order], counts[order]
        classes = seeds.classes_of(hashes, shapes)
        learnt = np.zeros(len(hashes), dtype=bool)  # words that training texts hold
        for a in range(0, len(hashes), _ROWS):
            z = min(a + _ROWS, len(hashes))
            lo, hi = np.searchsorted(key, [a * width, z * width])
            near = np.bincount(key[lo:hi] - a * width, weights=counts[lo:hi], minlength=(z - a) * width).reshape(z - a, 2, seeds.total)
            mine = np.flatnonzero(near.any(axis=(1, 2)))
            classes[a + mine] = seeds.place(near[mine, 0], near[mine, 1], shapes[a + mine])
            learnt[a + mine] = True
        types = np.bincount(classes[learnt], minlength=seeds.total)[seeds.first_rest:].tolist()
        rows, at = [], 0
        for chunk, own in zip(table.column("chunk").to_pylist(), each):
            rows.append({"chunk": chunk, "bucket": table.column("bucket")[0].as_py(), "classes": classes[back[at:at + len(own)]].astype("<u2").tobytes(),
                         "n_types": None})
            at += len(own)
        rows[0]["n_types"] = types
        out = pa.Table.from_pylist(rows, schema=_JOINED)
        release()
        return out

    return place


def _text_rows(n_buckets: int, first_rest: int, n_tokens: int, n_types: int):
    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        """What is known of each text of a chunk before the class bigrams are."""
        c = Chunk(left.to_pylist()[0])
        order, bucket, cut = _bucketed(c.hashes, n_buckets)
        place = {int(bucket[a]): (a, z) for a, z in zip(cut[:-1], cut[1:])}
        counts, classes = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        for b, x, y in zip(right.column("bucket").to_pylist(), right.column("counts"), right.column("classes")):
            a, z = place[b]
            if x.is_valid:
                counts[order[a:z]] = np.frombuffer(x.as_py(), dtype="<i8")
            else:
                classes[order[a:z]] = np.frombuffer(y.as_py(), dtype="<u2")
        end = c.shapes == SHAPES
        up = np.where(end, 0.0, np.log10(np.where(classes >= first_rest, counts + 0.5, np.maximum(counts, 1))))
        base = np.log10((counts + 0.5) / (n_tokens + 0.5 * (n_types + 1)))
        add = lambda x: np.add.reduceat(x[c.tokens], c.first)
        own = classes.astype("<u2")[c.tokens]
        out = pa.table({"doc_id": pa.array(c.doc_ids, pa.int64()), "training": pa.array(c.training), "n_known": pa.array(add((counts > 0).astype(np.int64))),
                        "base_score": pa.array(add(base)), "up": pa.array(add(up)),
                        "classes": pa.array([own[a:a + m].tobytes() for a, m in zip(c.first.tolist(), c.n.tolist())], pa.binary())}, schema=_TEXTS)
        release()
        return out

    return tell


def _class_bigrams(texts: DataFrame, total: int) -> np.ndarray:
    """Counts of neighbouring classes in the training texts: a row for each class, a column for the next token's."""
    def count(batches):
        table = np.zeros(total * total, dtype=np.int64)
        for b in batches:
            own = np.frombuffer(b"".join(b.column("classes").to_pylist()), dtype="<u2").astype(np.int64)
            before = np.r_[total - 1, own[:-1]] if len(own) else own
            table += np.bincount(before * total + own, minlength=total * total)
        cell = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(table[cell])], ["cell", "n"])

    out = np.zeros(total * total)
    for r in texts.where("training").select("classes").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]  # at most total * total cells
    return out.reshape(total, total)


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", clustered: int = CLUSTERED,
                n_classes: int = CLASSES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row.

    ``held_out`` is a boolean column expression; the model learns from the other rows
    (a null counts as false).  ``clustered`` words seed the ``n_classes`` classes; all other
    training words are then placed.  A null text is empty: its end token alone.  With
    nothing to learn from, all words are unseen.  Rows that repeat an id are scored each.
    """
    n = n_groups(docs, text_col, chunk_bytes)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw"),
                       (~F.coalesce(held_out, F.lit(False))).alias("training"))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "raw"), F.lit(n)))
    chunks = checkpointed(dealt.groupBy("chunk").applyInArrow(_make_chunk, _ddl(_CHUNK)))
    told = checkpointed(chunks.mapInArrow(_each(_send_counts(n), _SENT), _ddl(_SENT)).groupBy("bucket").applyInArrow(_sum_counts(clustered), _ddl(_TOLD)))
    sums = told.where("n_tokens is not null").agg(
        *[F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c in ("n_tokens", "n_types") for i in range(FIXED)]).first()
    n_tokens, n_types = (sum(sums[f"{c}{i}"] or 0 for i in range(FIXED)) for c in ("n_tokens", "n_types"))
    top = (told.where("top_hash is not null").select(F.explode(F.arrays_zip("top_hash", "top_count", "top_shape")).alias("t")).select("t.*")
           .orderBy(F.desc("top_count"), "top_hash").limit(clustered).collect())
    words = np.array([r["top_hash"] for r in top], dtype=np.int64).view(np.uint64)
    table = _bigrams(chunks, words)
    seeds = Seeds.build(words, exchange(table, FIXED, max(1, min(n_classes, len(words)))), table, FIXED)
    sent = chunks.mapInArrow(_each(_send_neighbours(n, seeds), _NEAR), _ddl(_NEAR))
    joined = checkpointed(sent.groupBy("bucket").applyInArrow(_place_words(seeds), _ddl(_JOINED)))
    types = joined.where("n_types is not null").agg(*[F.sum(F.get("n_types", F.lit(i))).alias(str(i)) for i in range(FIXED)]).first()
    given = told.select("chunk", "bucket", "counts").unionByName(joined.select("chunk", "bucket", "classes"), allowMissingColumns=True)
    texts = checkpointed(chunks.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(
        _text_rows(n, seeds.first_rest, n_tokens, n_types), _ddl(_TEXTS)))
    model = ClassModel.build(_class_bigrams(texts, seeds.total), FIXED, np.array([types[i] or 0 for i in range(FIXED)], dtype=np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def score(batches):
        m = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            each = b.column("classes").to_pylist()
            size = np.array([len(x) // 2 for x in each], dtype=np.int64)  # an end at least
            own = np.frombuffer(b"".join(each), dtype="<u2").astype(np.int64)
            before = np.r_[seeds.total - 1, own[:-1]]  # each text follows an end
            total = b.column("up").to_numpy() + np.add.reduceat(m.transition[before, own] - m.down[own], np.r_[0, np.cumsum(size)][:-1])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(~b.column("training").to_numpy(zero_copy_only=False)), pa.array(size), b.column("n_known"),
                 pa.array(np.full(len(size), n_tokens, dtype=np.int64)), b.column("base_score"), pa.array(total), pa.array(10 ** (-total / size))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return texts.mapInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def held_out_fold(id_col: str = "doc_id", fold: int = 5, out: int = 1):
    return crc_mod(F.col(id_col), fold) == out
