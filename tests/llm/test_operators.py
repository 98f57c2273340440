"""Every operator against a brute-force version, an exact round trip, or its SQL."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from storelens.llm import byte_bpe, patched_frames, suffix_sort, toxicity, toxicity_net
from storelens.llm.class_lm import held_out_fold, score_texts
from storelens.llm.class_model import exchange
from storelens.llm.decontamination import contaminated
from storelens.llm.order_minhash import aligned, near_duplicate_classes, normalised, similar
from storelens.llm.sharding import histogram_shards
from storelens.llm.wordhash import word_hashes
from tests.llm import brute
from tests.llm.conftest import SF

BOTH = pytest.mark.parametrize("where", ["small", "odd"])


@pytest.fixture
def rows_of(small, odd_rows, odd):
    return {"small": (SF, [tuple(r) for r in small]), "odd": (odd, odd_rows)}


def _key(rows):
    return sorted(rows, key=repr)


# -- 1: near duplicates

@BOTH
def test_order_minhash_classes(run, rows_of, where):
    sf, rows = rows_of[where]
    got = [tuple(r) for r in run("op1", sf).collect()]
    assert len(got) == len(rows)
    assert sorted(r for r in got if r[0] is not None) == brute.class_ids(rows, similar, normalised)


def test_alignment_in_a_band_equals_the_plain_one():
    r = random.Random(4)
    for _ in range(300):
        a = [r.randrange(6) for _ in range(r.randrange(1, 30))]
        b = [x for x in a if r.random() > 0.2] + [r.randrange(6) for _ in range(r.randrange(3))]
        if not b:
            continue
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        for least in range(1, max(len(a), len(b)) + 1):
            assert aligned(a, b, least) == (t[-1][-1] if t[-1][-1] >= least else 0)


def test_similarity_counts_shingles():
    """A tenth of the words changed here and there is no near copy; one run of changed words is."""
    words = [f"w{i}" for i in range(200)]
    scattered = [f"x{i}" if i % 10 == 5 else w for i, w in enumerate(words)]
    run = words[:80] + [f"x{i}" for i in range(20)] + words[100:]
    text = lambda w: " ".join(w).encode()
    assert not similar(text(words), text(scattered))
    assert similar(text(words), text(run))
    # 196 shingles, of which 157 must align
    assert similar(text(words), text(words[:161])) and not similar(text(words), text(words[:160]))
    assert similar(b"", b"") and not similar(b"", b"a") and similar(b"a b", b"a b") and not similar(b"a b", b"a b c")


def test_a_drifting_group_of_near_copies_is_one_class(spark):
    """Copies of copies: many pairs are below the limit, the chain holds the class together."""
    r = random.Random(9)
    words = [f"w{r.randrange(10 ** 6)}" for _ in range(150)]
    rows = []
    for i in range(120):
        rows.append((i, " ".join(words)))
        words = list(words)
        words[r.randrange(150)] = f"n{i}"
    rows += [(1000 + i, " ".join(f"u{r.randrange(10 ** 6)}" for _ in range(150))) for i in range(30)]
    got = dict(near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert {got[i] for i in range(120)} == {0}
    assert all(got[1000 + i] == 1000 + i for i in range(30))


# -- 2: shards

@BOTH
def test_shards(run, rows_of, where):
    sf, rows = rows_of[where]
    got = run("op2", sf).collect()
    assert _key((r["doc_id"], r["size"]) for r in got) == _key((d, len((t or "").encode()) + 1) for d, t in rows)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(16))
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert all(abs(sizes[s] - total / 16) <= largest for s in range(16))


def test_a_hot_text_is_split_by_its_ids(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same text " * 20).otherwise(
        F.concat(F.lit("text "), F.col("id").cast("string"), F.repeat(F.lit(" z"), 40))).alias("text"))
    got = histogram_shards(docs, 16, rows_per_range=50).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(sizes.values()) / 16
    assert len(got) == 3000 and max(abs(s - mean) for s in sizes.values()) <= 0.01 * mean + 300
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# -- 3, 4, 5: against SQL

@BOTH
@pytest.mark.parametrize("name", ["op3", "op4", "op5"])
def test_native_operators_equal_their_sql(run, oracle, rows_of, where, name):
    sf, _ = rows_of[where]
    cols, want = oracle(name, sf)
    got = run(name, sf).select(*cols).collect()
    if where == "odd" and name == "op3":  # the SQL counts words by doc_id; repeated and null ids are compared without that count
        keep = [i for i, c in enumerate(cols) if c not in ("n_repeat_words", "base_failed", "kept")]
        got, want = [tuple(r[i] for i in keep) for r in got], [tuple(r[i] for i in keep) for r in want]
        assert set(got) == set(want)
    else:
        assert _key(tuple(r) for r in got) == _key(tuple(r) for r in want)


def test_rules_of_urls(run, odd):
    got = {r["page_id"]: r for r in run("op4", odd).collect()}
    assert got[0]["host"] == "a.example.org" and got[0]["rule"] == "example.org/en/1" and got[0]["verdict"] == "block"
    assert (got[2]["rule"], got[2]["path"]) == ("com/fr/", "/fr/1")
    assert (got[4]["host"], got[5]["host"], got[6]["path"]) == ("", "", "")
    assert got[7]["path"] == "" and got[7]["rule"] is None
    assert got[10]["rule"] == "org/"


def test_blocks_of_the_benchmark_give_the_same_finds(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one, many = contaminated(docs, bench), contaminated(docs, bench, block_bytes=1000)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) != []


def test_a_short_item_is_found_in_a_very_long_text(spark):
    r = random.Random(2)
    item = " ".join(f"q{r.randrange(10 ** 6)}" for _ in range(12))
    long = " ".join(f"w{r.randrange(5000)}" for _ in range(20000))
    docs = spark.createDataFrame([(1, long), (2, long[:60000] + " " + item + " " + long[60000:])], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (6, "too short"), (7, None)], "item_id long, text string")
    assert [tuple(x) for x in contaminated(docs, bench).collect()] == [(2, 5, 8, 8)]


# -- 6: language model

@BOTH
def test_base_scores_and_counts(run, rows_of, where):
    sf, rows = rows_of[where]
    got = _key(tuple(r) for r in run("op6", sf).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect())
    want = _key(brute.base_scores(rows))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])


def test_the_class_model_beats_the_unigram_on_held_out_text(run):
    got = run("op6", "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def _class_scores(rows, clustered, n_classes):
    """Dictionary version of the class model: (doc_id, score) of each row."""
    def shape(w):
        return 16 if w is None else min(len(w), 8) - 1 + 8 * (w[-1:] in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

    texts = [(d, brute.tokens(t), brute.crc_mod(d, 5) != 1) for d, t in rows]
    taught = [[None] + x for _, x, training in texts if training]
    counts = Counter(w for x in taught for w in x[1:] if w is not None)
    hashed = {w: int(word_hashes([w])[0].view(np.int64)[0]) for w in counts}
    seeds = sorted(counts, key=lambda w: (-counts[w], hashed[w]))[:clustered]
    item = {w: i for i, w in enumerate(seeds)}
    table = np.zeros((len(seeds) + 17,) * 2)
    for x in taught:
        for u, w in zip(x, x[1:]):
            table[item.get(u, len(seeds) + shape(u)), item.get(w, len(seeds) + shape(w))] += 1
    classes = exchange(table, 17, max(1, min(n_classes, len(seeds))))
    k = int(classes.max()) + 1 - 17

    def follow(bigrams):
        after = Counter()
        for (_, b), n in bigrams.items():
            after[b] += n
        total, first = sum(after.values()), Counter()
        for (a, _), n in bigrams.items():
            first[a] += n
        prior = {b: (after[b] + 1) / (total + k + 17) for b in range(k + 17)}
        return (lambda a, b: math.log10((bigrams[a, b] + prior[b]) / (first[a] + 1))), after

    def class_bigrams(of):
        out = Counter()
        for x in taught:
            out.update(zip(map(of, x), map(of, x[1:])))
        return out

    first = {w: int(classes[item[w]]) if w in item else k + shape(w) for w in counts} | {None: k + 16}
    p, members = follow(class_bigrams(first.__getitem__))
    before, after = defaultdict(Counter), defaultdict(Counter)
    for x in taught:
        for u, w in zip(x, x[1:]):
            after[u][first[w]] += 1
            before[w][first[u]] += 1
    own = dict(first)
    for w in counts:
        if w not in item:
            def gain(c):
                size = members[c] + (counts[w] if c < k else 0)
                return (sum(n * p(a, c) for a, n in before[w].items()) + sum(n * p(c, b) for b, n in after[w].items())
                        - counts[w] * math.log10(max(size, 1))) * math.log(10)
            best = max(range(k), key=lambda c: (round(gain(c), 6), -c))
            if round(gain(best), 6) > round(gain(first[w]) + math.log(k), 6):
                own[w] = best
    p, members = follow(class_bigrams(own.__getitem__))
    types = Counter(own[w] for w in counts)

    def score(x):
        total, before = 0.0, k + 16
        for w in x:
            c = own[w] if w in own else k + shape(w)
            total += p(before, c)
            if c < k:
                total += math.log10(counts[w] / members[c])
            elif w is not None:
                total += math.log10((counts[w] + 0.5) / (members[c] + 0.5 * (types[c] + 1)))
            before = c
        return total

    return [(d, score(x)) for d, x, _ in texts], {w for w in counts if w not in item and own[w] < k}


@BOTH
def test_class_scores_equal_the_plain_ones_in_any_chunks(spark, rows_of, where):
    rows = rows_of[where][1]
    want, placed = _class_scores(rows, 40, 6)
    assert placed  # words that are no seeds take learnt classes
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (8 << 20, 3000):
        got = score_texts(docs, held_out_fold(), clustered=40, n_classes=6, chunk_bytes=size).select("doc_id", "score").collect()
        got, plain = _key(map(tuple, got)), _key(want)
        assert [g[0] for g in got] == [w[0] for w in plain]
        assert np.allclose([g[1] for g in got], [w[1] for w in plain])


def test_words_beyond_the_seeds_learn_their_class(spark):
    r = random.Random(4)
    pick = lambda c: f"{c}{min(r.randrange(10), r.randrange(10))}"
    docs = spark.createDataFrame([(i, " ".join(pick("ab"[j % 2]) for j in range(40))) for i in range(200)], "doc_id long, text string")
    got = score_texts(docs, held_out_fold(), clustered=4, n_classes=2).where("held_out").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    assert got[2] / got[0] > got[1] / got[0] + 0.25  # every other word is known to be of the other kind: log10(2) a word


# -- 7: repeats

@BOTH
def test_repeats(run, rows_of, where):
    sf, rows = rows_of[where]
    got = _key(tuple(r) for r in run("op7", sf).collect())
    assert got == _key((d, n, gone, spans, brute.sha(kept)) for d, n, gone, spans, kept in brute.repeats(rows))


def test_suffix_sort():
    r = np.random.default_rng(1)
    raw = r.integers(97, 99, 2000, dtype=np.uint8)
    raw[1000:1400] = raw[:400]
    h, start, group = suffix_sort.PrefixHashes(raw), r.integers(0, 1950, 1500), np.sort(r.integers(0, 40, 1500))
    order, stands = suffix_sort.sort_suffixes(h, start, group, 50)
    key = [(int(g), raw[x:x + 50].tobytes()) for g, x in zip(group, start)]
    assert [key[i] for i in order] == sorted(set(key))
    assert [key[i] for i in stands] == key and set(stands) == set(order)


# -- 8: token files

@BOTH
def test_token_files(run, rows_of, where):
    from tokenizers import Tokenizer

    sf, rows = rows_of[where]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = {}
    for r in run("op8", sf).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    own = defaultdict(list)
    for d, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        own[d].append((len(ids), brute.ids_crc(ids)))
    assert {d: sorted(v) for d, v in own.items()} == {d: sorted(x[1:] for x in v) for d, v in got.items()}
    at = 0
    for start, n in sorted((x[0], x[1]) for v in got.values() for x in v):
        assert start == at
        at += n
    firsts = [(d is not None, d or 0, x[0]) for d, v in got.items() for x in v]
    assert [f[2] for f in sorted(firsts)] == sorted(f[2] for f in firsts)


def test_patched_frames_round_trip():
    r = np.random.default_rng(3)
    docs = [r.integers(0, 50257, n) for n in (0, 1, 5, 1023, 1024, 1025, 5000)] + [np.full(3000, 7), np.r_[np.zeros(2000, int), [2 ** 32 - 1]]]
    data = patched_frames.write_file([*range(8), None], docs)
    ids, firsts, starts = patched_frames.read_index(data)
    assert ids == [*range(8), None]
    assert np.array_equal(patched_frames.decode_blocks(data, starts), np.concatenate(docs))
    for k, d in enumerate(docs):
        assert np.array_equal(patched_frames.read_document(data, k), d)
    with pytest.raises(ValueError):
        patched_frames.read_index(data[:-1])


# -- 9: toxicity

def test_toxicity_scores(run, rows_of):
    sf, rows = rows_of["odd"]
    got = run("op9", sf).collect()
    assert _key(r["doc_id"] for r in got) == _key(d for d, _ in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (brute.crc_mod(r["doc_id"], 5) == 0) for r in got if r["doc_id"] is not None)


def test_toxicity_on_held_out_labels(run):
    import duckdb

    labels = dict(duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.1/labels.parquet'").fetchall())
    got = [r for r in run("op9", "/root/testdata/sf0.1").where("held_out").collect() if r["doc_id"] in labels]
    right = np.mean([r["predicted"] == labels[r["doc_id"]] for r in got])
    found = np.mean([r["predicted"] for r in got if labels[r["doc_id"]] == 1])
    wrong = np.mean([r["predicted"] for r in got if labels[r["doc_id"]] == 0])
    assert right > 0.95 and found > 0.7 and wrong < 0.02


def test_training_uses_every_fitted_text(monkeypatch):
    """A full sample: each of its texts that are not held goes into at least three batches."""
    n = toxicity.SAMPLE_PER_CLASS
    texts = [toxicity_net.words_of(f"text{i}") for i in range(2 * n)]
    used = Counter()
    monkeypatch.setattr(toxicity_net.ToxicityNet, "_gradients", lambda self, own, target: used.update(own) or {})
    toxicity.train(texts, np.arange(2 * n) % 2 * 1.0, np.ones(2 * n))
    assert len(used) == 2 * n * 4 // 5 and min(used.values()) >= 3


def test_gradients_of_the_network():
    texts = [toxicity_net.words_of("hello idiot world foo bar " * 9 + " zebra"), toxicity_net.words_of("nice day"), b""]
    y = np.array([1.0, 0, 0])
    net = toxicity_net.ToxicityNet()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        out = net.logits(texts)
        return np.mean(np.logaddexp(0, out) - y * out)

    for name, g in net._gradients(texts, y).items():
        value = net.p[name]
        at, want = ((g[0][1], 2), g[1][1][2]) if isinstance(g, tuple) else (tuple(s // 2 for s in value.shape), g[tuple(s // 2 for s in value.shape)])
        kept = value[at]
        value[at] = kept + 1e-4
        up = loss()
        value[at] = kept - 1e-4
        down = loss()
        value[at] = kept
        assert abs((up - down) / 2e-4 - want) < 1e-5


# -- 10: byte-level BPE

@BOTH
def test_byte_bpe_equals_the_library(run, rows_of, where):
    import tiktoken

    sf, rows = rows_of[where]
    ranks = byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), brute.sha(",".join(map(str, ids)).encode()), brute.sha((t or "").encode())))
    assert _key(tuple(r) for r in run("op10", sf).collect()) == _key(want)


def test_ids_as_arrays_in_batches_equal_the_text_of_ids(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BATCH_ROWS", 3)
    ranks = byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "a b", "it's 12345 \u65e5\u672c", " \n", "x" * 3000, "a b"] * 3)], "doc_id long, text string").coalesce(1)
    plain = {r[0]: r for r in byte_bpe.encode(docs, ranks, P.PATTERN, carry=["doc_id"]).select("carried.doc_id", "n_tokens", "ids_text", "decoded").collect()}
    got = byte_bpe.encode(docs, ranks, P.PATTERN, carry=["doc_id"], as_ids=True).select("carried.doc_id", "n_tokens", "token_ids", "decoded").collect()
    assert len(got) == len(plain) == 21
    for r in got:
        want = plain[r["doc_id"]]
        assert (r["n_tokens"], ",".join(map(str, r["token_ids"])), r["decoded"].encode()) == (want["n_tokens"], want["ids_text"], bytes(want["decoded"]))


def test_forgetting_words_changes_nothing(spark):
    ranks = byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    a = byte_bpe.encode(docs, ranks, P.PATTERN, carry=["doc_id"])
    b = byte_bpe.encode(docs, ranks, P.PATTERN, carry=["doc_id"], chunk_bytes=3000, words=50)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


# -- all: an empty table

@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 11)])
def test_an_empty_table_gives_no_rows(run, empty, name):
    assert run(name, empty).count() == 0
