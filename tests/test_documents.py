import os
import tempfile

import pyarrow as pa
from hypothesis import given, settings, strategies as st

from storelens.operators import chunking as V1
from storelens.sources import documents as S
from tests.conftest import rows


def _check_tiling(text, spans, size=1000, overlap=200):
    if not text:
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (s0, e0), (s1, e1) in zip(spans, spans[1:]):
        assert s1 <= e0, "gap"
        assert e0 - s1 <= overlap, "overlap too large"
        assert s1 > s0 and e1 > e0
    for s, e in spans:
        piece = text[s:e]
        assert e - s <= size or not any(sep in piece for sep in V1.SEPARATORS)


def test_chunk_fixtures():
    long_word = "x" * 1500
    texts = ["", "a" * 1000, "Łódź " * 400, "§ 1. Zasady\n§ 2. Zwroty " + "słowo " * 300,
             "para one\n\npara two " * 120, long_word + " tail", "a.b." * 400]
    for t in texts:
        _check_tiling(t, V1.split_spans(t))
    assert V1.split_spans(long_word + " tail") == [(0, 1500), (1500, 1505)]
    assert V1.split_spans("a" * 1000) == [(0, 1000)]
    sec = "\n§ 1 " + "w " * 200 + "\n§ 2 " + "w " * 200
    spans = V1.split_spans(sec, size=300)
    # "\n§" cuts the sections; inside a section "§" cuts again, so the leading
    # newline is a chunk of its own and the next chunk starts at the marker
    assert [sec[s:e] for s, e in spans[:1]] == ["\n"] and sec[spans[1][0]:].startswith("§ 1")
    assert any(sec[s:].startswith("\n§ 2") for s, _ in spans)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .\n§ł")), max_size=900), st.integers(20, 120))
def test_chunk_tiling_property(text, size):
    overlap = size // 4
    _check_tiling(text, V1.split_spans(text, size=size, overlap=overlap), size, overlap)


def test_chunk_documents_distributed(spark):
    docs = spark.createDataFrame([(1, "ab " * 700, "pl"), (2, "", "pl"), (3, None, "en")],
                                 "doc_id long, text string, lang string")
    chunks = V1.chunk_documents(docs, carry=["lang"])
    got = chunks.collect()
    assert {r.doc_id for r in got} == {1} and all(r.lang == "pl" for r in got)
    inv = V1.chunk_invariants(chunks, docs).first()
    assert inv.covered == 2100 and inv.no_gap and inv.overlap_ok and inv.size_ok and inv.ends_at_length


def test_assemble_pages(spark):
    pages = spark.createDataFrame([("d1", 2, "c"), ("d1", 0, "a"), ("d1", 1, None), ("d2", 0, ""),
                                   ("d3", 10, "k"), ("d3", 9, "j")] + [("d3", i, str(i)) for i in range(9)],
                                  "doc string, page_no int, text string")
    assert rows(S.assemble_pages(pages)) == [("d1", "ac"), ("d2", ""), ("d3", "012345678jk")]


def test_scan_documents_and_index(spark):
    folder = tempfile.mkdtemp(prefix="storelens-docs-")
    for name, body in [("a.pdf", b"page one\fpage two"), ("b.pdf", b"solo"), ("c.txt", b"skip")]:
        with open(os.path.join(folder, name), "wb") as f:
            f.write(body)
    pages = S.scan_documents(spark, folder, lambda b: b.decode().split("\f"))
    docs = S.assemble_pages(pages)
    assert sorted(r.text for r in docs.collect()) == ["page onepage two", "solo"]
    path = os.path.join(tempfile.mkdtemp(prefix="storelens-index-"), "index")
    idx = spark.createDataFrame([(1, "t", [0.5, 1.0])], S.INDEX_SCHEMA)
    S.save_index(idx, path)
    loaded, err = S.load_index(spark, path)
    assert err is None and loaded.count() == 1
    empty, err = S.load_index(spark, path + "-missing")
    assert err == S.INDEX_MISSING_MESSAGE and empty.count() == 0


def test_attach_document(spark):
    req = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "q3")], "rid long, request string")
    docs = spark.createDataFrame([(1, "a.pdf", "TXT"), (2, "b.PDF", "X")], "did long, file_name string, doc_text string")
    out = {r.rid: r.request for r in S.attach_document(req, docs, "rid", "did").collect()}
    assert out[1] == S.ATTACH_TEMPLATE_HEAD + "TXT" + S.ATTACH_TEMPLATE_TAIL + "q1"
    assert out[2] == "q2" and out[3] == "q3"


def test_a_chunk_that_begins_with_its_separator_is_of_valid_size(spark):
    from storelens.operators import chunking as V1
    docs = spark.createDataFrame([(1, "a " + "w" * 1200)], "doc_id long, text string")
    r = V1.chunk_invariants(V1.chunk_documents(docs, with_length=True)).first()
    assert r.size_ok and r.no_gap and r.ends_at_length


def test_texts_are_cut_a_bounded_slice_at_a_time(spark):
    texts = ["a" * 40, None, "ł" * 30, "", "b" * 300, "c", "d" * 99]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    slices = list(V1.byte_slices(batch.slice(0), 1, 100))
    assert [s.column(0).to_pylist() for s in slices] == [[0, 1, 2, 3], [4], [5, 6]]
    assert [s.column(0).to_pylist() for s in V1.byte_slices(batch.slice(2, 3), 1, 100)] == [[2, 3], [4]]
    docs = spark.createDataFrame([(i if i else None, f"{i} word. " * 400 * i, i if i % 2 else None) for i in range(40)], "doc_id long, text string, n int")
    got = V1.chunk_documents(docs, carry=["n"], with_length=True)
    want = [(r.doc_id, i, s, e, r.text[s:e], r.n, len(r.text)) for r in docs.collect() for i, (s, e) in enumerate(V1.split_spans(r.text))]
    assert rows(got) == sorted(want)
    assert sum(len(f"{i} word. " * 400 * i) for i in range(40)) > 2 * V1.STEP_BYTES
