import random
import tracemalloc

from hypothesis import given, settings, strategies as st
import numpy as np
import pyarrow as pa
import pytest

from storelens.operators import pages as P
from storelens.operators import vectors as V
from tests.conftest import SF_SMALL, rows


def _brute(index, queries, k):
    out = {}
    for qid, q in queries:
        cand = sorted((round(float(sum((np.float64(a) - np.float64(b)) ** 2 for a, b in zip(q, x))), 6), i)
                      for i, x in index if x is not None)
        out[qid] = [(i, d) for d, i in cand[:k]]
    return out


def test_nearest_batch_matches_brute_force_with_edges(spark):
    rng = np.random.default_rng(3)
    vecs = [(i, [float(x) for x in rng.standard_normal(8).astype(np.float32)]) for i in range(60)]
    vecs += [(100, vecs[0][1]), (101, vecs[0][1]), (102, None)]   # identical vectors, a null vector
    index = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    queries = [(1000 + i, v) for i, v in vecs[:7]]
    qdf = spark.createDataFrame(queries, "query_id long, vector array<float>")
    exp = _brute([(i, v) for i, v in vecs], queries, 3)
    for block in (100, 2):          # one broadcast block, and the multi-block path
        got = V.nearest_batch(index, qdf, k=3, max_block=block).collect()
        res = {}
        for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
            res.setdefault(r.query_id, []).append((r.vec_id, r.dist))
        assert res == exp
    few = spark.createDataFrame(vecs[:2], "vec_id long, embedding array<float>")
    assert V.nearest_batch(few, qdf, k=3).count() == 2 * len(queries)   # fewer rows than k


def test_nearest_single_and_context(spark):
    index = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [5.0, 5.0])],
                                  "vec_id long, embedding array<float>")
    got = rows(V.nearest(index, [0.1, 0.0], k=3), "rank", "vec_id")
    assert got == [(1, 1), (2, 2), (3, 3)]
    hits = spark.createDataFrame([(7, 2, "b"), (7, 1, "a")], "query_id long, rank long, text string")
    assert V.assemble_context(hits).first().context == "a\n\n...\n\nb\n\n...\n\n"


def test_nearest_approx_recall(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    queries = emb.select(emb.vec_id.alias("query_id"), emb.embedding.alias("vector"))
    approx = V.nearest_approx(emb, queries, k=3, target_group=100)
    exact = V.nearest_batch(emb, queries, k=3)
    assert approx.agg({"rank": "max"}).first()[0] <= 3
    recall = V.recall_at_k(approx, exact).first().recall
    assert recall > 0.5


def test_page_search(spark):
    pages = spark.createDataFrame([
        (1, "<html><script>var zwrot=1;</script><p>Zwrot towaru w 14 dni</p><!-- zwrot --></html>"),
        (2, "<style>p{zwrot:0}</style><p>towar towar towar</p>"),
        (3, "<p>Reklamacja i zwrot</p>")], "page_id long, html string")
    phrases = spark.createDataFrame([(1, "zwrot towaru"), (2, "nic")], "phrase_id long, phrase string")
    got = rows(P.page_search(pages, phrases, k=2), "phrase_id", "page_id", "n_terms", "rank")
    assert got == [(1, 1, 2, 1), (1, 3, 1, 2)]


def _brute_page_search(pages, phrases, k):
    import re
    post = {}
    for pid, html in pages:
        for w in re.findall(r"[a-z0-9]+", html.lower()):
            post.setdefault(pid, {}).setdefault(w, 0)
            post[pid][w] += 1
    out = []
    for qid, text in phrases:
        qt = set(re.findall(r"[a-z0-9]+", text.lower()))
        scored = []
        for pid, tf in post.items():
            hit = [tf[t] for t in qt if t in tf]
            if hit:
                scored.append((-len(hit), -sum(hit), pid))
        for r, (n, h, pid) in enumerate(sorted(scored)[:k], 1):
            out.append((qid, pid, -n, -h, r))
    return sorted(out)


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 3), st.integers(1, 3))
def test_page_search_rounds_equal_exhaustive_ranking(spark, seed, k, depth):
    """Small depths force several threshold rounds; a tiny vocabulary makes
    common words and tied scores; the result must equal the plain ranking."""
    rnd = random.Random(seed)
    vocab = ["a", "b", "c", "d", "e", "f", "g", "h"]
    pages = [(i, "<p>" + " ".join(rnd.choice(vocab[:rnd.randint(2, 8)]) for _ in range(rnd.randint(1, 12))) + "</p>")
             for i in range(40)]
    phrases = [(j, " ".join(rnd.sample(vocab, rnd.randint(1, 4)))) for j in range(12)] + [(99, "zzz")]
    pdf = spark.createDataFrame(pages, "page_id long, html string")
    qdf = spark.createDataFrame(phrases, "phrase_id long, phrase string")
    got = rows(P.page_search(pdf, qdf, k=k, depth=depth), "phrase_id", "page_id", "n_terms", "hits", "rank")
    assert got == _brute_page_search(pages, phrases, k)


def test_nearest_approx_salting_does_not_change_results(spark):
    """Cutting buckets into many parts on both sides (target_group=7) must
    give exactly the candidates of unsalted buckets."""
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    queries = emb.select(emb.vec_id.alias("query_id"), emb.embedding.alias("vector"))
    whole = V.nearest_approx(emb, queries, k=3, target_group=1_000_000)
    salted = V.nearest_approx(emb, queries, k=3, target_group=7)
    cols = ["query_id", "vec_id", "dist", "rank"]
    assert rows(whole, *cols) == rows(salted, *cols)


def test_nearest_batch_dot_and_cosine_match_brute_force(spark):
    rng = np.random.default_rng(11)
    vecs = [(i, [float(x) for x in rng.standard_normal(6).astype(np.float32)]) for i in range(40)]
    index = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    queries = [(500 + i, v) for i, v in vecs[:5]]
    qdf = spark.createDataFrame(queries, "query_id long, vector array<float>")

    def dist(q, x, metric):
        q, x = np.array(q, np.float64), np.array(x, np.float64)
        dot = 0.0
        for a, b in zip(q, x):
            dot = dot + a * b
        return round(-dot, 6) if metric == "dot" else round(1.0 - dot / (np.linalg.norm(q) * np.linalg.norm(x)), 6)

    for metric in ("dot", "cosine"):
        exp = {qid: [i for _, i in sorted((dist(q, x, metric), i) for i, x in vecs)[:3]] for qid, q in queries}
        got = {}
        for r in sorted(V.nearest_batch(index, qdf, k=3, metric=metric, max_block=7).collect(),
                        key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == exp, metric


def test_nearest_batch_blocks_meet_across_partitions(spark):
    """With partition coalescing off, every block lives in its own shuffle
    partition; query and index blocks must still meet (their keys must hash
    alike on both sides of the cogroup)."""
    import pyarrow.parquet as pq
    t = pq.read_table(f"{SF_SMALL}/embeddings.parquet").to_pydict()
    ids = np.array(t["vec_id"], np.int64)
    xm = np.array(t["embedding"], np.float32).astype(np.float64)
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    queries = emb.select(emb.vec_id.alias("query_id"), emb.embedding.alias("vector"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "false")
        got = {}
        for r in V.nearest_batch(emb, queries, k=3, max_block=64).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    finally:
        spark.conf.set(key, old)
    for i in range(len(ids)):
        d = ((xm[i] - xm) ** 2).sum(1)
        best = [ids[j] for j in np.lexsort((ids, d))[:3]]
        assert [got[ids[i]][r] for r in (1, 2, 3)] == best


def _brute_sets(qm, xm, k, metric):
    import numpy as np
    if metric == "l2":
        d = ((qm[:, None, :] - xm[None, :, :]) ** 2).sum(2)
    else:
        n = np.linalg.norm(qm, axis=1)[:, None] * np.linalg.norm(xm, axis=1)[None, :]
        dot = qm @ xm.T
        d = 1 - np.divide(dot, n, out=np.zeros_like(dot), where=n > 0)
    return [set(np.argsort(r, kind="stable")[:k]) for r in d]


def test_no_neighbour_is_lost_at_any_scale():
    import numpy as np
    r = np.random.default_rng(1)
    for scale in (1.0, 1e3, 1e6):
        xm, qm = r.standard_normal((2000, 64)) * scale, r.standard_normal((20, 64)) * scale
        q, ids, _ = V._pair_topk(np.arange(20), qm, np.arange(2000), xm, 3, "l2")
        assert [set(ids[q == i]) for i in range(20)] == _brute_sets(qm, xm, 3, "l2")


def test_many_equal_vectors_and_a_zero_vector():
    import numpy as np
    xm = np.ones((5000, 8))
    q, ids, d = V._pair_topk(np.arange(300), np.ones((300, 8)), np.arange(5000), xm, 3, "l2")
    assert len(q) == 900 and set(ids) == {0, 1, 2} and not d.any()
    xm = np.vstack([np.zeros(4), np.eye(4)])
    q, ids, d = V._pair_topk(np.arange(2), np.vstack([np.zeros(4), np.eye(4)[0]]), np.arange(5), xm, 2, "cosine")
    assert [(int(a), int(b), float(c)) for a, b, c in zip(q, ids, d)] == [(0, 0, 1.0), (0, 1, 1.0), (1, 1, 0.0), (1, 0, 1.0)]


def test_approximate_search_returns_every_query(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, vector array<double>")
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert rows(V.nearest_approx(none, q), "query_id", "vec_id", "short") == [(1, None, True), (2, None, True)]
    one = spark.createDataFrame([(9, [1.0, 0.1])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id, r.short) for r in V.nearest_approx(one, q, k=3).collect()}
    assert got == {(1, 9, True), (2, None, True)}
    assert V.nearest_batch(none, q.withColumnRenamed("query_id", "qq"), query_id="qq").columns == ["qq", "vec_id", "dist", "rank"]


def test_approximate_recall(spark):
    import numpy as np
    r = np.random.default_rng(2)
    x = r.standard_normal((3000, 16)) + r.standard_normal((30, 16))[r.integers(0, 30, 3000)] * 3
    idx = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = idx.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    assert V.recall_at_k(V.nearest_approx(idx, q), V.nearest_batch(idx, q)).first()[0] >= 0.9


def test_a_tile_of_queries_is_ranked_by_itself(monkeypatch):
    r = np.random.default_rng(5)
    qm, xm = r.standard_normal((3000, 4)), r.standard_normal((9000, 4))
    want = np.lexsort((np.arange(9000)[None, :].repeat(3, 0), np.round(((qm[:3, None] - xm[None]) ** 2).sum(-1), V.ROUND)))[:, :3]
    ranked, inner = [], V._topk_rows
    monkeypatch.setattr(V, "PAIR_STEP", 1024)
    monkeypatch.setattr(V, "_topk_rows", lambda qi, *a: ranked.append(len(qi)) or inner(qi, *a))
    q, ids, _ = V._pair_topk(np.arange(3000), qm, np.arange(9000), xm, 3, "l2")
    assert len(q) == 9000 and ids[:9].reshape(3, 3).tolist() == want.tolist()
    assert max(ranked) < 3000


def test_vectors_of_several_widths_are_refused():
    with pytest.raises(ValueError, match="widths"):
        V._matrix(pa.array([[1.0, 2.0], [1.0], [1.0, 2.0, 3.0]]))


def test_sketches_are_compared_in_small_tiles():
    r = np.random.default_rng(6)
    qs, xs = (r.integers(0, 2 ** 63, (n, 3), dtype=np.uint64) for n in (1500, 9000))
    asked = np.stack([np.arange(1500), np.zeros(1500, dtype=np.int64)])
    tracemalloc.start()
    met = {(int(a), int(b)) for q, x in V._candidates(asked, None, qs, np.zeros(9000, dtype=np.int64), None, xs, 70) for a, b in zip(q, x)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = {(i, int(j)) for i in range(1500) for j in np.flatnonzero(np.bitwise_count(qs[i] ^ xs).sum(1) <= 70)}
    assert met == want and want
    assert peak < 32 << 20


def test_buckets_looked_into_are_those_probed():
    r = np.random.default_rng(7)
    planes, reach = V.hyperplanes(6)[:, :5], 0.4
    qm = r.normal(size=(60, 6))
    at = V._project(qm, planes)
    row, masks = V._probed(np.abs(at).reshape(-1, 5), reach)
    assert all(sorted(masks[row == i].tolist()) == sorted(V._probes(m, reach).tolist()) for i, m in enumerate(np.abs(at).reshape(-1, 5)))
    own = V._codes(at).reshape(-1)
    want = {(int(i) // V.N_TABLES, int(i) % V.N_TABLES, int(own[i] ^ m)) for i, m in zip(row, masks)}
    buckets = (np.arange(32, dtype=np.uint64) | np.arange(V.N_TABLES, dtype=np.uint64)[:, None] << np.uint64(V.MAX_PLANES)).reshape(-1)
    b, q = np.nonzero(V._looked_into(qm, planes, buckets, reach))
    assert {(int(i), int(j) // 32, int(j) % 32) for i, j in zip(q, b)} == want and len(want) > 60 * V.N_TABLES


@pytest.mark.parametrize("shift, scale", [(0.0, 1.0), (100.0, 1e-3), (0.0, 1e18)])
def test_far_rows_are_ruled_out_before_their_sketches_are_compared(monkeypatch, shift, scale):
    """Rows of one bucket; also vectors that single precision can't tell apart or hold."""
    r = np.random.default_rng(8)
    qm, xm = (shift + scale * r.normal(size=(n, 16)) for n in (400, 6000))
    qs, xs = (r.integers(0, 2 ** 63, (n, 3), dtype=np.uint64) for n in (400, 6000))
    d = ((qm[:, None] - xm[None]) ** 2).sum(-1)
    limit = np.sort(d, axis=1)[:, 20]
    compared, inner = [], V._apart
    monkeypatch.setattr(V, "_apart", lambda a, b: compared.append(np.broadcast(a, b).size // 3) or inner(a, b))
    asked = np.stack([np.arange(400), np.zeros(400, dtype=np.int64)])
    met = {(int(a), int(b)) for q, x in V._candidates(asked, qm, qs, np.zeros(6000, dtype=np.int64), xm, xs, 96, limit) for a, b in zip(q, x)}
    want = {(int(i), int(j)) for i, j in np.argwhere(d <= limit[:, None]) if np.bitwise_count(qs[i] ^ xs[j]).sum() <= 96}
    assert want <= met and len(met) <= 1.1 * len(want)
    assert sum(compared) < d.size / 50


def test_the_best_so_far_are_distinct_and_lower_the_limit():
    best = V._Best(3, 2, np.full(3, np.inf))
    best.add(np.array([2, 0, 2, 2]), np.array([7, 5, 7, 8]), np.array([0.5, 1.0, 0.4, 3.0]))
    best.add(np.array([2, 0]), np.array([9, 5]), np.array([1.0, 1.0]))
    assert [c.tolist() for c in best.rows()] == [[0, 2, 2], [5, 7, 9], [1.0, 0.4, 1.0]]
    assert best.limit[:2].tolist() == [np.inf, np.inf] and abs(best.limit[2] - 1.0) < 1e-5
    best.add(np.array([2, 2]), np.array([3, 4]), np.zeros(2))
    assert best.may(np.array([2, 2, 2, 0]), np.array([2, 4, 9, 9])).tolist() == [True, False, False, True]


@pytest.mark.parametrize("target_group", [50_000, 700])
def test_approximate_search_finds_the_nearest_within_its_limits(spark, target_group):
    """Against the definition: rows met in a bucket of any table and close enough in their sketches."""
    r = np.random.default_rng(9)
    x = np.concatenate([r.standard_normal((1500, 16)), r.standard_normal((20, 16))[r.integers(0, 20, 500)] + 0.01 * r.standard_normal((500, 16))])
    x = x.astype(np.float32).astype(float)
    ids = np.r_[np.arange(1900), np.arange(100)]  # some ids come twice, with other vectors
    index = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    queries = index.where("vec_id % 5 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    planes, sketch = V.hyperplanes(16)[:, :3], V.sketch_planes(16)
    reach, gap = V.search_limits(index, planes, sketch, 3, V.TARGET_RECALL, "vec_id", "embedding")
    at, words, want = V._project(x, planes), V._sketches(x, sketch), {}
    for i in np.flatnonzero(ids % 5 == 0):
        meet = np.round((((at >= 0) != (at[i] >= 0)) * at[i] ** 2).sum(-1), V.PLACES).min(-1) <= reach
        near = np.flatnonzero(meet & (np.bitwise_count(words ^ words[i]).sum(-1) <= gap))
        for d, j in zip(np.round(((x[near] - x[i]) ** 2).sum(1), V.ROUND), ids[near]):
            found = want.setdefault(int(ids[i]), {})
            found[int(j)] = min(d, found.get(int(j), np.inf))
    want = sorted((q, j) for q, found in want.items() for j in sorted(found, key=lambda j: (found[j], j))[:3])
    assert rows(V.nearest_approx(index, queries, k=3, target_group=target_group), "query_id", "vec_id") == want


def test_approximate_search_shuffles_vectors_once(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    plan = V.nearest_approx(e, e.selectExpr("vec_id AS query_id", "embedding AS vector"))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow [__g" in plan and "BroadcastHashJoin [__g" in plan and "array<bigint>" not in plan


def test_approximate_search_keeps_a_query_without_an_id(spark):
    index = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 1.0]), (None, [2.0, 1.0])], "query_id long, vector array<double>")
    got = {(r.query_id, r.vec_id, r.rank, r.short) for r in V.nearest_approx(index, q, k=1, bucket_rows=2).collect()}
    assert got == {(1, 1, 1, False), (None, None, None, True)}


@pytest.mark.parametrize("shift, scale, used", [(0.0, 1.0, {np.float32}), (100.0, 1e-2, {np.float32, np.float64}), (0.0, 1e18, {np.float64})])
def test_exact_search_bounds_in_single_precision_where_it_can(monkeypatch, shift, scale, used):
    r = np.random.default_rng(10)
    qm, xm = (shift + scale * r.normal(size=(n, 16)) for n in (300, 5000))
    d = np.round(np.stack([V._exact(np.broadcast_to(q, xm.shape), xm, "l2") for q in qm]), V.ROUND)
    want = [np.lexsort((np.arange(5000), row))[:3].tolist() for row in d]
    seen, inner = set(), V._sides
    monkeypatch.setattr(V, "_sides", lambda a, b, metric, dtype: seen.add(dtype) or inner(a, b, metric, dtype))
    q, ids, _ = V._pair_topk(np.arange(300), qm, np.arange(5000), xm, 3, "l2")
    assert ids.reshape(300, 3).tolist() == want and q.tolist() == np.repeat(np.arange(300), 3).tolist()
    assert seen == used
