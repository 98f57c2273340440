"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles, lower-cased, each labelled with its
occurrence number.  A sketch takes, under one random order, the three least
labelled shingles and lists them in text order, so it agrees with probability
close to the cube of the similarity and only when the order agrees as well.  Two
sketches make a bucket key; documents that share a key are candidates.

Candidates are verified by aligning the two shingle sequences (longest common
subsequence inside a diagonal band): similarity = aligned shingles / shingles of the
longer text, at least 0.8.  The band is as wide as the number of unaligned
shingles that a passing pair may have, so it loses no passing pair.  A passing pair
has a shingle Jaccard similarity of at least 0.8 / 1.2 = 0.67, and with 64 keys of two
sketches becomes a candidate with 99.7 %; one of 0.8 all but surely (1 - 4e-9).

Equal texts are collapsed first.  In a bucket every member is compared with its
neighbour and with the leader of its share (large buckets are shared out), in an
order that differs from bucket to bucket: first in the buckets of ``FIRST`` keys, then
in all buckets, where two members speak for each class.  What is torn after that is settled
inside tasks, in blocks of bounded size: each member outside the bucket's largest class
meets all members of other classes.  A pair that passes shares at least as many labelled shingles
as it aligns, so a count of shared shingles (exact, from the block's own postings) leaves out
pairs without loss, and all others are aligned, most shared first, unless the links
found so far in the block already join them.  A block gives at most one link
per member, and no pair becomes a row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm.common import checkpointed, release, released, written_in_few
from storelens.llm.components import components
from storelens.llm.wordhash import FEW_BYTES, U64, blocks, mix, shingle_hashes, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: shingles per sketch, sketches per bucket key, bucket keys
LEAST, PER_KEY, KEYS = 3, 2, 64
#: keys whose buckets are worked through first
FIRST = 8
#: members of a bucket that are handled together
SHARE = 2048
#: bytes of text that a block holds of either side
BLOCK_BYTES = 16 << 20


def _orders(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return (rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1),
            rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32))


_MUL, _ADD = _orders(PER_KEY * KEYS)


def labelled_shingles(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the shingles, equal ones told apart by their occurrence number."""
    h = shingle_hashes(words, min(SHINGLE, len(words)))
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.r_[False, s[1:] == s[:-1]]
    if same.any():
        run = np.maximum.accumulate(np.where(same, 0, np.arange(len(s))))
        label = np.empty(len(s), dtype=np.uint64)
        label[order] = (np.arange(len(s)) - run).astype(np.uint64)
        h = np.where(label > 0, mix(h + label * U64(0xD1342543DE82EF95)), h)
    return h


def bucket_keys(shingles: np.ndarray) -> np.ndarray:
    """The document's 64 bucket keys."""
    n = len(shingles)
    low = (shingles >> U64(32)).astype(np.uint32)
    take = min(LEAST, n)
    sketches = np.zeros(len(_MUL), dtype=np.uint64)
    step = max(1, (4 << 20) // n)
    for a in range(0, len(_MUL), step):
        rank = low[None, :] * _MUL[a:a + step, None] + _ADD[a:a + step, None]
        rows = np.arange(len(rank))
        picked = np.empty((len(rank), take), dtype=np.int64)
        for j in range(take):
            picked[:, j] = rank.argmin(axis=1)
            if j + 1 < take:
                rank[rows, picked[:, j]] = np.uint32(0xFFFFFFFF)
        picked.sort(axis=1)  # text order
        for j in range(take):
            sketches[a:a + step] = mix(sketches[a:a + step] * U64(3) + shingles[picked[:, j]])
    keys = sketches[0::PER_KEY].copy()
    for j in range(1, PER_KEY):
        keys = mix(keys * U64(5) + sketches[j::PER_KEY])
    return keys + np.arange(KEYS, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)


def shingles_of(texts: list[bytes]) -> list[np.ndarray]:
    """The labelled shingles of each normalised text, a bounded amount of text at a time."""
    out = []
    for lo, hi in blocks(texts, FEW_BYTES):
        hashes, owner, _, _ = word_hashes(texts[lo:hi])
        cut = np.searchsorted(owner, np.arange(hi - lo + 1))
        out += [labelled_shingles(hashes[a:z]) if z > a else np.zeros(0, dtype=np.uint64) for a, z in zip(cut, cut[1:])]
    return out


def _words(text: bytes) -> list[bytes]:
    return text.split()


def _shingles(words: list[bytes]) -> list[tuple]:
    return list(zip(*[words[j:] for j in range(min(SHINGLE, len(words)))]))


def normalised(text: str | None) -> bytes:
    """Lower-cased words with single spaces (bytes.split() knows exactly the ASCII white space)."""
    return b" ".join((text or "").lower().encode().split())


@released
def _sign(batches):
    for b in (b.slice(a, 512) for b in batches for a in range(0, b.num_rows, 512)):
        texts = [normalised(t) for t in b.column("text").to_pylist()]
        prints = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
        keys = [bucket_keys(found).view(np.int64) if len(found) else None for found in shingles_of(texts)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                                          pa.array([len(t) for t in texts], pa.int64())], ["doc_id", "print", "keys", "size"])


def aligned(a: list, b: list, least: int) -> int:
    """Longest common subsequence of two lists inside the band that a
    result of ``least`` or more can use, by bit-parallel rows (0 when it is less)."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < min(len(a), len(b)) - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[lo:len(a) - end], b[lo:len(b) - end]
    common = lo + end
    if not x or not y:
        return common if common >= least else 0
    need = max(0, least - common)
    up, down = len(x) - need, len(y) - need  # unaligned items allowed on either side
    if up < 0 or down < 0:
        return 0
    places: dict = {}
    for j, s in enumerate(y):
        places[s] = places.get(s, 0) | (1 << j)
    full = (1 << len(y)) - 1
    v = full
    for i, s in enumerate(x):
        m = places.get(s, 0)
        if m:
            first = i - up  # cells of this row inside the band: i - up .. i + down
            m &= (1 << (i + down + 1)) - 1
            if first > 0:
                m = (m >> first) << first
            t = v & m
            v = ((v + t) | (v - t)) & full
    got = common + len(y) - bin(v).count("1")
    return got if got >= least else 0


def similar(a: bytes, b: bytes, threshold: float = SIMILARITY) -> bool:
    """Whether two normalised texts align in at least ``threshold`` of the longer one's shingles."""
    x, y = _shingles(_words(a)), _shingles(_words(b))
    if not x or not y:
        return x == y
    least = -(-int(round(threshold * 1_000_000)) * max(len(x), len(y)) // 1_000_000)
    if min(len(x), len(y)) < least:
        return False
    return aligned(x, y, least) >= least


@released
def _verify(batches):
    for b in batches:
        ok = [similar(x, y) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(ok)], ["u", "v", "ok"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    x = texts.select(F.col("node").alias("u"), F.col("words").alias("x"))
    y = texts.select(F.col("node").alias("v"), F.col("words").alias("y"))
    return pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(_verify, "u long, v long, ok boolean")


@released
def _normalise(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([normalised(t) for t in b.column("text").to_pylist()], pa.binary())],
                                         ["node", "words"])


def _least_aligned(x: np.ndarray | int, y: int) -> np.ndarray | int:
    """Shingles that must align in a passing pair of texts with x and y shingles."""
    return -(-int(round(SIMILARITY * 1_000_000)) * np.maximum(x, y) // 1_000_000)


def links_of_block(node: np.ndarray, root: np.ndarray, asks: np.ndarray, asking: np.ndarray, texts: list[bytes]) -> list[tuple[int, int]]:
    """Links (u > v) that join the classes of a block's members, at most one per member.

    Rows are members that are asked, of which ``asks`` marks those that ask elsewhere or here as
    well, and (``asking``) those that ask here.  Each asking member meets each asked one of
    another class; of two that ask each other the greater node does.
    """
    found = shingles_of(texts)
    asked = np.flatnonzero(~asking)
    sizes = np.array([len(f) for f in found], dtype=np.int64)
    flat = np.concatenate([found[i] for i in asked]) if len(asked) else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(asked)), sizes[asked])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    parent: dict = {}

    def find(c):
        while parent.setdefault(c, c) != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    links = []
    for i in np.flatnonzero(asking):
        low, high = np.searchsorted(flat, found[i], "left"), np.searchsorted(flat, found[i], "right")
        n = high - low
        ends = np.cumsum(n)
        shared = np.bincount(owner[np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - ends + n, n)], minlength=len(asked))
        may = np.flatnonzero((shared >= _least_aligned(sizes[asked], sizes[i])) & (root[asked] != root[i])
                             & (~asks[asked] | (node[asked] < node[i])))
        for j in may[np.argsort(-shared[may], kind="stable")]:
            k = asked[j]
            a, b = find(int(root[i])), find(int(root[k]))
            if a != b and similar(texts[i], texts[k]):
                parent[max(a, b)] = min(a, b)
                links.append((int(max(node[i], node[k])), int(min(node[i], node[k]))))
    return links


def _settle(_key, block):
    node, root = (block.column(c).to_numpy() for c in ("node", "root"))
    asks, asking = (block.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("asks", "asking"))
    links = links_of_block(node, root, asks, asking, block.column("words").to_pylist()) if asking.any() else []
    release()
    return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})


def _settled(left: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between all similar members of different classes in torn buckets.

    A bucket's members outside its largest class ask, all are asked.  Either side is dealt into
    shares of at most about ``SHARE`` members and ``BLOCK_BYTES``, and each asking share meets
    each asked one in a block.
    """
    classes = left.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    whole = classes.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.max(F.struct("n", "b", "root")).alias("top"))

    def shares(n, b):
        return F.greatest(F.lit(1), F.ceil(n / SHARE), F.ceil(b / BLOCK_BYTES)).cast("int")

    dealt = whole.select(F.col("bucket").alias("b3"), F.col("top.root").alias("most"), shares(F.col("n"), F.col("b")).alias("all_shares"),
                         shares(F.col("n") - F.col("top.n"), F.col("b") - F.col("top.b")).alias("ask_shares"))
    rows = left.join(dealt, F.col("bucket") == F.col("b3")).withColumn("asks", F.col("root") != F.col("most"))

    def own(n):
        return F.pmod(F.xxhash64("node"), F.col(n)).cast("int")

    def places(n, place):
        return F.transform(F.sequence(F.lit(0), F.col(n) - 1), place)

    def block(i, j, asking):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(asking).alias("asking"))

    asked = places("ask_shares", lambda i: block(i, own("all_shares"), False))
    asking = F.when(F.col("asks"), places("all_shares", lambda j: block(own("ask_shares"), j, True))).otherwise(F.array().cast(
        "array<struct<i:int,j:int,asking:boolean>>"))
    placed = rows.select("bucket", "node", "root", "asks", F.explode(F.concat(asked, asking)).alias("to")).select("bucket", "to.*", "node", "root", "asks")
    words = texts.select(F.col("node").alias("n6"), "words")
    return (placed.join(words, F.col("node") == F.col("n6")).select("bucket", "i", "j", "node", "root", "asks", "asking", "words")
            .groupBy("bucket", "i", "j").applyInArrow(_settle, "u long, v long"))


def _neighbours(rows: DataFrame) -> DataFrame:
    """(node, other) pairs of neighbours and leaders within the shares of a bucket, then
    of the shares' first members; only pairs of different classes."""
    one = lambda: F.struct("node", "root")
    turned = rows.withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares"))).withColumn("turn", F.xxhash64("node", "bucket"))
    share = Window.partitionBy("bucket", "share").orderBy("turn", "node")
    inside = turned.select("bucket", "node", "root", "turn", F.lag(one()).over(share).alias("before"), F.first(one()).over(share).alias("leader"))
    over = Window.partitionBy("bucket").orderBy("turn", "node")
    firsts = inside.where("before is null").select("node", "root", F.lag(one()).over(over).alias("before"), F.first(one()).over(over).alias("leader"))
    both = inside.select("node", "root", "before", "leader").union(firsts)
    apart = F.filter(F.array("before", "leader"), lambda o: o.isNotNull() & (o["root"] != F.col("root")))
    return both.select("node", F.explode(apart).alias("o")).select("node", F.col("o.node").alias("other"))


def _speakers(rows: DataFrame) -> DataFrame:
    """Two members at most of each class in a bucket, by a hash: the class meets its neighbours through them."""
    turn = F.struct(F.xxhash64("node", "bucket").alias("turn"), "node")
    classes = rows.groupBy("bucket", "root").agg(F.min(turn).alias("a"), F.max(turn).alias("z"), F.max("shares").alias("shares"))
    return classes.select("bucket", "root", "shares", F.explode(F.array_distinct(F.array("a.node", "z.node"))).alias("node"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Classes joined by new links, worked out between the classes alone."""
    a = roots.select(F.col("node").alias("u"), F.col("root").alias("a"))
    b = roots.select(F.col("node").alias("v"), F.col("root").alias("b"))
    between = components(links.join(a, "u").join(b, "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")))
    onto = between.select(F.col("node").alias("old"), F.col("root").alias("new"))
    return written_in_few(roots.join(onto, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")))


def _with_class(members: DataFrame, roots: DataFrame) -> DataFrame:
    return (members.join(roots.select(F.col("node").alias("n2"), "root"), F.col("node") == F.col("n2"), "left")
            .select("bucket", "k", "node", "size", "shares", F.coalesce("root", "node").alias("root")))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and class_id, the least doc_id of its class.

    Null and empty texts, and texts of white space, have no words and form one
    class.  A text under five words is one shingle of all its words.  Rows that
    repeat a doc_id are one document.  A row with a null id is in the class of
    the texts equal to its own (null when there are none) and is not searched
    for near copies.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = checkpointed(rows.mapInArrow(_sign, "doc_id long, print binary, keys array<long>, size long"))
    # equal texts: one node, named by the least id; partial aggregation meets large groups of copies
    nodes = signed.groupBy("print").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"), F.first("size").alias("size"))
    member = signed.groupBy("doc_id", "print").agg(F.count(F.lit(1)).alias("copies"))
    named = signed.groupBy("print").agg(F.min("doc_id").alias("node"))

    entries = nodes.where("node is not null").select("node", "size", F.posexplode("keys").alias("k", "bucket"))
    shared = (entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
              .select(F.col("bucket").alias("b2"), F.ceil(F.col("n") / SHARE).alias("shares")))
    members = checkpointed(entries.join(shared, F.col("bucket") == F.col("b2")).select("bucket", "k", "node", "size", "shares").distinct())

    wanted = members.select(F.col("node").alias("w")).distinct()
    texts = rows.join(wanted, F.col("doc_id") == F.col("w")).select(F.col("doc_id").alias("node"), "text").dropDuplicates(["node"])
    texts = checkpointed(texts.mapInArrow(_normalise, "node long, words binary"))

    roots = checkpointed(members.select("node").distinct().withColumn("root", F.col("node")))
    for search in ("first", "neighbours", "blocks"):
        left = _with_class(members.where(F.col("k") < FIRST) if search == "first" else members, roots)
        if search == "blocks":  # whatever shares a bucket and is still apart
            split = checkpointed(left)
            torn = split.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a <> z").select("bucket")
            if not torn.limit(1).count():
                break
            new = written_in_few(_settled(checkpointed(split.join(torn, "bucket")), texts).distinct())
        else:
            found = _neighbours(left if search == "first" else _speakers(left))
            found = found.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()
            new = written_in_few(_verified(found, texts).where("ok").select("u", "v"))
        if new.limit(1).count():
            roots = _merged(roots, new)

    # back to the documents: rows that repeat an id tie their texts together as well
    ids = member.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1 and doc_id is not null")
    if ids.limit(1).count():
        tie = (member.join(named, "print").join(ids, "doc_id").where("node is not null")
               .select(F.col("doc_id").alias("u"), F.col("node").alias("v")))
        every = named.where("node is not null").select("node").union(tie.select("u")).distinct()
        roots = every.join(roots.select(F.col("node").alias("n4"), "root"), F.col("node") == F.col("n4"), "left")
        roots = _merged(roots.select("node", F.coalesce("root", "node").alias("root")), tie)
    grouped = signed.select("doc_id", "print").join(named, "print")
    return (grouped.join(roots.select(F.col("node").alias("n2"), "root"), F.col("node") == F.col("n2"), "left")
            .select("doc_id", F.coalesce("root", "node").alias("class_id")))


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of the least id of every near-duplicate class.

    Rows that repeat that id are kept once; rows with a null id are left as they
    are, as no id can tell them apart.
    """
    classes = near_duplicate_classes(docs, id_col, text_col)
    chosen = classes.where("doc_id is not null").groupBy("class_id").agg(F.min("doc_id").alias("__chosen_id")).select("__chosen_id").distinct()
    once = docs.where(F.col(id_col).isNotNull()).join(chosen, F.col(id_col) == F.col("__chosen_id"), "left_semi").dropDuplicates([id_col])
    return once.unionByName(docs.where(F.col(id_col).isNull()))
