"""Operators 11 to 13 against plain versions, the tokenizers library and SQL."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from storelens.llm import queries, sharded_kmeans, tier_packing
from storelens.llm.periodic_runs import find_runs, periodic_runs, runs_of_texts
from tests.llm.conftest import SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# -- 11: periodic runs

def plain_runs(words, least=12):
    """Every period by itself: stretches where words that far apart are identical."""
    numbers = {}
    w = np.array([numbers.setdefault(x, len(numbers)) for x in words])
    found = {}
    for p in range(1, len(w) // 2 + 1):
        same = np.concatenate([[False], w[p:] == w[:-p], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s >= p:
                found.setdefault((s, e + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items() if e - s >= max(least, 2 * p))


def plain_row(doc_id, text):
    words = WORDS.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_random_words_equal_the_plain_search():
    r = random.Random(11)
    for _ in range(400):
        texts = []
        for _ in range(r.randint(1, 4)):
            words = [r.choice("abcdefgh"[:r.choice([1, 2, 3, 5])]) for _ in range(r.randint(0, 60))]
            if r.random() < 0.4 and words:
                words = (words[:r.randint(1, 8)] * 20)[:len(words)] + words[:r.randint(0, 5)]
            texts.append(r.choice([" ", "\n", "\t "]).join(words))
        least = r.choice([1, 4, 12])
        for text, (n, runs, _) in zip(texts, runs_of_texts(texts, least)):
            assert n == len(text.split())
            assert [tuple(x) for x in runs.tolist()] == plain_runs(text.split(), least)


def test_runs_of_fibonacci_and_equal_words():
    a, b = "a", "ab"
    for _ in range(12):
        a, b = b, b + a
    assert [tuple(x) for x in find_runs(np.array([ord(c) for c in b]), 1).tolist()] == plain_runs(b, 1)
    assert find_runs(np.zeros(3000, dtype=np.int64)).tolist() == [[0, 3000, 1]]


def test_collapsing_keeps_the_first_period_of_nested_runs():
    text = "x " + " ".join(["a b a b c"] * 4) + " y"
    (_, runs, collapsed), = runs_of_texts([text], 4)
    assert runs.tolist() == [[1, 4, 2], [1, 20, 5], [6, 4, 2], [11, 4, 2], [16, 4, 2]]
    assert collapsed == "x a b c y"


@pytest.mark.parametrize("where", ["small", "odd"])
def test_word_runs_query(run, small, odd, odd_rows, where):
    sf, rows = (SF, [tuple(r) for r in small]) if where == "small" else (odd, odd_rows)
    got = [tuple(r)[:8] for r in run("op11", sf).collect()]
    assert sorted(got, key=repr) == sorted((plain_row(*r) for r in rows), key=repr)


def test_word_runs_of_a_long_text_carry_columns_and_take_an_empty_table(spark, run, empty):
    unit = [f"w{i}" for i in range(700)]
    text = " ".join((unit * 400)[:250_000])
    row, = periodic_runs(spark.createDataFrame([(text, 5, 6)], "text string, runs int, n_words int")).collect()
    assert (row.carried.runs, row.carried.n_words, row.n_words) == (5, 6, 250_000)
    assert [tuple(r) for r in row.runs] == [(0, 250_000, 700)] and row.collapsed == " ".join(unit)
    assert run("op11", empty).collect() == []


# -- 12: packing

LIBRARY = Tokenizer.from_file(P.path("word_bpe_49k.json"))


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def check_packing(rows, pieces):
    docs = {}
    for d, text in rows:
        docs.setdefault(d, []).append(library_ids(text))
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append(p)
        assert any(len(ids) == p.doc_tokens and zlib.crc32(np.array(ids[p.start:p.start + p.length], dtype="<u4").tobytes()) == p.ids_crc32
                   for ids in docs[p.doc_id])
    for held in windows.values():
        held.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in held])
        assert [p.offset for p in held] == [0, *ends[:-1]] and ends[-1] == held[0].context and len({p.step_id for p in held}) == 1
        assert ends[-1] <= 4096 and ends[-1] & (ends[-1] - 1) == 0  # full: no padding
    for d, texts in docs.items():
        mine = sorted((p.start, p.length) for p in pieces if p.doc_id == d)
        assert sum(length for _, length in mine) == sum(map(len, texts))
        if len(texts) == 1:
            assert [a for a, _ in mine] == [0, *np.cumsum([n for _, n in mine])[:-1]]
    steps = {}
    for s, held in windows.items():
        steps.setdefault(held[0].step_id, []).append(held[0].context)
    assert all(len(set(c)) == 1 and sum(c) <= tier_packing.STEP_IDS for c in steps.values())
    return windows


@pytest.mark.parametrize("where", ["small", "odd"])
def test_packed_pieces_are_the_librarys_ids(run, small, odd, odd_rows, where):
    sf, rows = (SF, [tuple(r) for r in small]) if where == "small" else (odd, odd_rows)
    windows = check_packing(rows, run("op12", sf).collect())
    short = sum(1 for held in windows.values() if held[0].context < 256)
    assert short <= 8  # the last window's powers of two


def test_words_encode_as_the_library_does():
    enc, lib = tier_packing.SpacedEncoder(P.path("word_bpe_49k.json"), 50), LIBRARY
    r = random.Random(3)
    marks = ["don't", "It's", "a.b", "<|endoftext|>", "<|startoftext|>x", "<|", "́e", "é", "Σας", "İ", "ﬁ", "9½", " ", " y", "\x1c", "\x85z",
             "日本語", "x" * 300, "A,", "B!", "'s", "'S", "n't", "__", "1a2", "​", "ß", "Ǆ", "한국", "가", "", "\r\n", "\x0b", "Où***", "a''", "l'été's", "b-'d", "ÿ.,!", "Å|", "µm", "ªº", "×", "o÷", "!", "T.", "ǅ'll"]
    for _ in range(400):
        text = "".join(r.choice(marks) + r.choice([" ", "", "\n", "  ", "\t"]) for _ in range(r.randint(0, 14)))
        assert enc.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_tiers_fill_from_shorter_rests_and_pad_nothing():
    r = random.Random(5)
    for _ in range(60):
        sizes = [r.choice([1, 7, 255, 256, 300, 1000, 4096, 5000, 9000, r.randint(1, 6000)]) for _ in range(r.randint(1, 80))]
        windows = tier_packing.pack(sizes)
        assert all(sum(p[2] for p in pieces) == context and context & (context - 1) == 0 for context, pieces in windows)
        spans = sorted((d, s, n) for _, pieces in windows for d, s, n in pieces)
        for d, size in enumerate(sizes):
            at = 0
            for _, s, n in (x for x in spans if x[0] == d):
                assert s == at and n > 0
                at += n
            assert at == size
        assert sum(1 for context, _ in windows if context not in tier_packing.TIERS) <= 8
        groups = tier_packing.step_groups(windows)
        by = {}
        for g, (context, pieces) in zip(groups, windows):
            by.setdefault((context, g), []).append(sum(n * n for *_, n in pieces))
        for context in {c for c, _ in windows}:
            counts = [len(v) for (c, _), v in by.items() if c == context]
            assert max(counts) - min(counts) <= 1
    assert tier_packing.pack([]) == []


def test_step_groups_cost_about_the_same():
    r = random.Random(6)
    windows = tier_packing.pack([r.randint(20, 3000) for _ in range(4000)])
    cost = {}
    for g, (context, pieces) in zip(tier_packing.step_groups(windows), windows):
        cost.setdefault(context, {}).setdefault(g, 0)
        cost[context][g] += sum(n * n for *_, n in pieces)
    longest = sorted(cost[4096].values())
    assert len(longest) > 10 and longest[-1] <= 1.2 * longest[len(longest) // 2]


def test_packing_of_small_chunks_and_an_empty_table(spark, run, empty, small):
    docs = spark.createDataFrame([tuple(r) for r in small], "doc_id long, text string")
    pieces = tier_packing.pack_documents(docs, chunk_bytes=20_000).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append((p.start, p.ids))
    for d, text in small:
        assert np.frombuffer(b"".join(bytes(i) for _, i in sorted(by_doc[d])), dtype="<u4").tolist() == library_ids(text)
    assert run("op12", empty).collect() == []


# -- 13: clustering over column blocks

def plain_lloyd(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2 ** 900 else int(x) * 1024 for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in kept[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((x - y) ** 2 for x, y in zip(v, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        named = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (c, _) in zip(kept, named) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    named = assign()
    own = [sum(d for c, d in named if c == j) for j in range(len(centroids))]
    return sorted((((i, c, d, own[c], sum(own), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()))
                   for (i, _), (c, d) in zip(kept, named)), key=repr)


def _vectors(folder, rows):
    pq.write_table(pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32())),
                             "label": pa.array([0] * len(rows), pa.int32()), "cluster": pa.array([1] * len(rows), pa.int32()),
                             "vector": pa.array(["x"] * len(rows))}), f"{folder}/embeddings.parquet")
    return str(folder)


def test_clusters_equal_plain_rounds_and_the_sql(run, tmp_path):
    r = np.random.default_rng(13)
    rows = [(i, r.normal(size=64).astype(np.float32).tolist()) for i in range(60)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (100, [0.0] * 64), (101, [0.0] * 64), (102, [3e3] * 64), (103, [-7e4] * 32 + [1e-9] * 32)]
    rows += [(200, [1.0] * 63), (201, None), (202, [1.0] * 63 + [float("nan")]), (203, [float("inf")] + [1.0] * 63), (204, [None] + [1.0] * 63), (205, [])]
    folder = _vectors(tmp_path, rows)
    got = sorted((tuple(x) for x in run("op13", folder).collect()), key=repr)
    assert got == plain_lloyd(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    assert sorted(con.execute(queries.ORACLES["op13_dimension_kmeans"]).fetchall(), key=repr) == got


@pytest.mark.parametrize("n", [0, 3])
def test_clusters_of_few_vectors(run, tmp_path, n):
    rows = [(i, [float(i)] * 64) for i in range(n)] + [(9, [1.0])]
    got = sorted((tuple(x) for x in run("op13", _vectors(tmp_path, rows)).collect()), key=repr)
    assert got == plain_lloyd(rows) and len(got) == n


def test_many_groups_shards_and_blocks(spark, monkeypatch):
    """Groups of few rows over several shards, null ids and huge components, which take Python's integers."""
    monkeypatch.setattr(sharded_kmeans, "GROUP_ROWS", 16)
    monkeypatch.setattr(sharded_kmeans, "SHARD_GROUPS", 2)
    r = np.random.default_rng(14)
    rows = [(i, r.normal(size=64).tolist()) for i in range(150)] + [(None, [0.5] * 64), (None, [0.25] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for blocks in (1, 3):
        found, centroids = sharded_kmeans.cluster(df, blocks=blocks)
        got = [tuple(x) for x in sharded_kmeans.with_inertia(found, centroids).collect()]
        assert sorted(got, key=repr) == plain_lloyd(rows)


def test_huge_components_neither_overflow_nor_round():
    a = sharded_kmeans.fixed_point(np.array([[1e300, -3.0], [2.0 ** 55, 0.1]]))
    assert a.dtype == object and a.tolist() == [[int(1e300) * 1024, -3072], [2 ** 65, 102]]
    b = np.array([[0, 5], [2 ** 70, -1]], dtype=object)
    assert sharded_kmeans.partial_distances(a, b).tolist() == [[sum((x - y) ** 2 for x, y in zip(p, q)) for q in b.tolist()] for p in a.tolist()]
    c = np.array([[2 ** 40, 1]])
    assert sharded_kmeans.partial_distances(c, np.array([[0, 0]])).tolist() == [[2 ** 80 + 1]]
