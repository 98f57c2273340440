"""The gram index against the scan."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storelens.operators import phrases as P
from storelens.operators.sqlpolicy import phrase_match
from storelens.session import scratch_path


def test_places_pack_and_unpack():
    r = np.random.default_rng(1)
    for n in (1, 2, 100, 5000):
        places = np.sort(r.choice(P.BLOCK_ROWS, n, replace=False))
        assert P._unpacked(P._packed(places)).tolist() == places.tolist()
    for places in ([0], [P.BLOCK_ROWS - 1], [0, 1, 129, 16513, P.BLOCK_ROWS - 1], list(range(300))):
        assert P._unpacked(P._packed(np.array(places))).tolist() == places
    assert len(P._packed(np.arange(1000))) == 1000


@pytest.mark.parametrize("mode", ["lower", "exact"])
def test_index_equals_the_scan(spark, mode, monkeypatch):
    monkeypatch.setattr(P, "GATHER_BYTES", 2000)
    texts = ["Ala ma kota", "ala MA", "kot", "", None, "ŁÓDŹ łódź", "aaaa", "a%b_c", "no\nbreak", "x" * 500 + "needle", "ab", "ba", "aba bab"]
    rows = [(i * 40_000 - 80_000, t) for i, t in enumerate(texts)] + [(None, "Ala ma")]
    df = spark.createDataFrame(rows, "i long, t string").repartition(4)
    index = P.PhraseIndex(spark, scratch_path(spark, "test-phrases"), mode)
    index.build(df, "i", "t")
    asked = ["ala ma", "Ala", "a", "", "ko", "ŁÓ", "%", "b_c", "\nb", "needle", "xn", "abab", "aba", "aaa", "zzz", None, "kota k"]
    phrases = spark.createDataFrame(list(enumerate(asked)), "phrase_id long, phrase string")
    found = index.search(phrases).collect()
    got = sorted((r.phrase_id, r.id) for r in found)
    want = sorted((k, r.i) for k, p in enumerate(asked) if p is not None for r in df.where(phrase_match("t", p, mode)).select("i").collect() if r.i is not None)
    assert got == want and want
    verified = {r.phrase_id: r.n_verified for r in found}
    assert verified[9] == 1 and verified[2] < len(texts)


def test_modes_without_an_index_are_refused(spark):
    with pytest.raises(ValueError):
        P.PhraseIndex(spark, "/tmp/none", "collation")


def test_postings_of_odd_texts():
    ids = [70_000, -1, 5, 5, 9, 6]
    texts = ["abca", "", "a\U0010FFFFb", "xy", "\x00" * 3, "žab"]
    got = {}
    for b in P._postings([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], ["id", "text"])]):
        for gram, block, data in zip(*(c.to_pylist() for c in b.columns)):
            got[gram, block] = P._unpacked(data).tolist()
    want = {}
    for i, t in zip(ids, texts):
        for n in range(P.GRAM + 1):
            for a in range(len(t) - n + 1):
                want.setdefault((t[a:a + n], i // P.BLOCK_ROWS), set()).add(i % P.BLOCK_ROWS)
    assert got == {k: sorted(v) for k, v in want.items()}


def test_texts_are_not_shuffled_with_the_phrases(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"text {i} of some rows") for i in range(50)], "i long, t string")
    index = P.PhraseIndex(spark, scratch_path(spark, "test-phrases"), "lower")
    index.build(df, "i", "t")
    checked = []
    monkeypatch.setattr(P, "cut_lineage", lambda d: checked.append(d) or d.checkpoint())
    found = index.search(spark.createDataFrame([(1, "of some"), (2, "text 1")], "phrase_id long, phrase string"))
    assert sorted(found.groupBy("phrase_id", "n_verified").count().collect()) == [(1, 50, 50), (2, 11, 11)]
    assert len(checked) == 1  # the candidates' texts are read once
