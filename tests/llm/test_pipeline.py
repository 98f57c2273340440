"""The pipeline's stages against brute-force versions, each on its own input."""

import public_tokenizers as P
import pytest

import corpus_pipeline
from storelens.llm.order_minhash import normalised, similar
from tests.llm import brute
from tests.llm.conftest import SF


def _stages(spark, sf_dir, folder):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs))
    return out


@pytest.mark.parametrize("where", ["small", "odd"])
def test_stages(spark, odd, tmp_path, where):
    import duckdb
    import tiktoken

    sf = SF if where == "small" else odd
    made = _stages(spark, sf, tmp_path)
    columns = made[0][1].columns
    assert [n for n, _ in made[1:]] == ["toxicity", "near_dedup", "suffix_dedup", "decontaminate", "bpe"]
    assert all(d.columns == columns for _, d in made[:-1])
    rows = {n: [(r["doc_id"], r["text"]) for r in d.collect()] for n, d in made}
    # toxicity: a subset of the rows
    assert {repr(r) for r in rows["toxicity"]} <= {repr(r) for r in rows["documents"]}
    # near copies: the least id of each class; rows without an id stay
    classes = brute.class_ids(rows["toxicity"], similar, normalised)
    assert sorted(d for d, _ in rows["near_dedup"] if d is not None) == sorted({c for _, c in classes})
    assert sum(d is None for d, _ in rows["near_dedup"]) == sum(d is None for d, _ in rows["toxicity"])
    # repeats: what is left of each text
    left = []
    for d, _, gone, _, kept in brute.repeats(rows["near_dedup"]):
        text = kept.decode("utf-8", "ignore")
        if not gone or text.strip(" \t\n\x0b\x0c\r"):
            left.append((d, text))
    assert sorted(map(repr, left)) == sorted(repr((d, t or "")) for d, t in rows["suffix_dedup"])
    # benchmark items: exact shingle containment in SQL over the stage's input
    con = duckdb.connect()
    from storelens.llm.queries import ORACLES
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/suffix_dedup/*.parquet')")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{sf}/benchmark.parquet')")
    bad = {r[0] for r in con.execute(ORACLES["op5_containment_search"]).fetchall()}
    assert sorted(map(repr, rows["decontaminate"])) == sorted(repr(r) for r in rows["suffix_dedup"] if r[0] not in bad)
    # token ids
    from storelens.llm.byte_bpe import load_ranks
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    last = made[-1][1].collect()
    assert sorted(repr((r["doc_id"], r["text"])) for r in last) == sorted(repr((d, t or "")) for d, t in rows["decontaminate"])
    assert all(r["token_ids"] == enc.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["token_ids"]) for r in last)


def test_an_empty_table_passes_through(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_planted_cases(spark, tmp_path):
    """Copies, near copies, a shared passage and a benchmark passage are caught; clean documents stay."""
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    r = random.Random(5)
    text = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randrange(10 ** 6)}" for _ in range(n))
    clean = [(i, text(120)) for i in range(60)]
    near = clean[1][1].split()
    near[40] = "other"
    passage, item = text(60), text(30)
    docs = clean + [(100, clean[0][1]), (101, " ".join(near)), (102, text(50) + " " + passage), (103, text(50) + " " + passage + " " + text(20)),
                    (104, text(80) + " " + item + " " + text(80))]
    pq.write_table(pa.table({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs], "lang": ["en"] * len(docs), "source": ["s"] * len(docs),
                             "n_chars": [len(t) for _, t in docs]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [0], "text": [item]}), tmp_path / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([d for d, _ in clean], pa.int64()), "quality": [1] * 60, "toxic": [0] * 60}), tmp_path / "labels.parquet")
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {d for d, _ in clean} | {102, 103}
    assert passage in got[102] and passage[:100] not in got[103]
    assert all(got[d] == t for d, t in clean)


def test_stages_take_texts_in_batches_of_bounded_bytes(spark):
    """An executor holds a batch on both sides of the pipe: its bytes are bounded, unless the session has a bound of its own."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    def seen(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(4000).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1000).alias("text"))
    stage = corpus_pipeline._stage(lambda _spark, rows, _dir: rows.mapInArrow(seen, "size long, n long"))
    try:
        spark.conf.unset(key)
        made = stage(spark, docs, "").collect()
        assert max(r["size"] for r in made) < (1 << 20) + 2000
        assert sum(r["n"] for r in made) == 4000
        spark.conf.set(key, "2m")
        made = stage(spark, docs, "").collect()
        assert 1 << 20 < max(r["size"] for r in made) < (2 << 20) + 2000
    finally:
        spark.conf.unset(key)


def test_the_training_sample_starts_no_other_python_workers(spark, monkeypatch):
    """Rows given as a list would go through Python workers of a kind of their own, which stay beside the others."""
    from pyspark import SparkContext
    from pyspark.sql import functions as F

    from storelens.llm.toxicity import training_sample

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))

    def never(*_a, **_k):
        raise AssertionError("a list of rows was dealt out through Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", never)
    texts, target, weight = training_sample(docs, labels, F.lit(True), per_class=15)
    assert len(texts) == 30 and target.sum() == 15 and set(weight.tolist()) == {20 / 15}
    assert all(int(t.split()[1]) % 2 == y for t, y in zip(texts, target))


def test_a_task_hashes_few_texts_at_once():
    """Signatures, the search for items and the network's inputs take little memory besides the texts, however many there are."""
    import random
    import tracemalloc

    from storelens.llm.decontamination import ItemIndex
    from storelens.llm.order_minhash import shingles_of
    from storelens.llm.toxicity_net import Batch, ToxicityNet

    r = random.Random(7)
    texts = [" ".join(f"{r.choice('abcdefgh')}{r.randrange(10 ** 6)}" for _ in range(400)).encode() for _ in range(500)]  # 1.6 MB
    index, net = ItemIndex.build([(1, texts[3])]), ToxicityNet()
    net.logits(texts[:1])
    batch = Batch(texts[:150])

    def taken(work):
        tracemalloc.start()
        try:
            work()
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert [t for t, *_ in index.search(texts, 0.8)] == [3]
    assert taken(lambda: shingles_of(texts)) < 24 << 20
    assert taken(lambda: index.search(texts, 0.8)) < 24 << 20
    assert taken(lambda: net._inputs(batch)) < 16 << 20
