import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from storelens.llm import queries

SF = "/root/testdata/sf0.001"
CLASHING = ["node", "bucket", "chunk", "raw", "row", "words", "print", "keys", "u", "v", "root", "y", "size", "shard", "host", "good", "carried", "numbers",
            "score", "item_id", "first", "own", "n"]


@pytest.fixture(scope="session")
def small(spark):
    """Rows of the small documents table."""
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()


def _base():
    texts = [r["text"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["text"]).to_pylist()[:14]]
    bench = pq.read_table(f"{SF}/benchmark.parquet", columns=["text"]).to_pylist()[0]["text"]
    return texts, bench


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empties, white space, ties, repeated rows, one very long text, one unbroken word."""
    texts, bench = _base()
    near = texts[1].split()
    near[len(near) // 2] = "replaced"
    long = " ".join(t + "\n" for t in texts) * 6
    return [(i, t) for i, t in enumerate(texts)] + [
        (20, None), (21, ""), (22, " \n\t \x0b\x0c\r "), (23, texts[0]), (23, texts[0]), (24, " ".join(near)), (25, long), (26, "x" * 3000 + "é" * 700),
        (27, "one two three four"), (28, "a   b\n  c \n d  "), (29, texts[2] + " " + bench), (30, bench), (None, texts[3]), (None, None),
        (31, "Idiot moron scum trash clown"), (32, "日本語 \x1c mixed lines 12345 it's")]


def _write(folder, docs, with_extra):
    n = len(docs)
    cols = {"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string()),
            "lang": pa.array(["en" if i % 3 else None for i in range(n)], pa.string()),
            "source": pa.array([f"src{i % 3}" if i % 5 else None for i in range(n)], pa.string()),
            "n_chars": pa.array([len(t or "") for _, t in docs], pa.int64())}
    if with_extra:
        cols |= {c: pa.array([7] * n, pa.int64()) for c in CLASHING}
    pq.write_table(pa.table(cols), f"{folder}/documents.parquet")
    bench = pq.read_table(f"{SF}/benchmark.parquet")
    pq.write_table(bench if n else bench.slice(0, 0), f"{folder}/benchmark.parquet")
    known = [(d, i) for i, (d, _) in enumerate(docs) if d is not None and i % 2 == 0]
    pq.write_table(pa.table({"doc_id": pa.array([d for d, _ in known] + [None] * min(n, 1), pa.int64()),
                             "quality": pa.array([int(i % 3 > 0) for _, i in known] + [None] * min(n, 1), pa.int64()),
                             "toxic": pa.array([int(i % 4 == 0) for _, i in known] + [1] * min(n, 1), pa.int64())}), f"{folder}/labels.parquet")
    urls = ["http://A.Example.org/en/12", "https://example.org/es/3", "http://x.example.com/fr/1?q=/de/", "https://b.com/de/2#top", None, "", "no scheme/org/",
            "http://example.org", "ftp://host.net/en/4://x", "http://u@h.org:80/p", "http://notexample.org/es/1", "http://a.co.uk/en/6", "http://a.co.uk/en/6"] if n else []
    pq.write_table(pa.table({"page_id": pa.array(range(len(urls)), pa.int64()), "url": pa.array(urls, pa.string()),
                             "html": pa.array([""] * len(urls), pa.string())}), f"{folder}/pages.parquet")


@pytest.fixture(scope="session")
def odd(tmp_path_factory, odd_rows):
    folder = tmp_path_factory.mktemp("odd")
    _write(folder, odd_rows, True)
    return str(folder)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    _write(folder, [], True)
    return str(folder)


@pytest.fixture(scope="session")
def run(spark):
    def of(name, sf_dir):
        query = next(q for k, q in queries.QUERIES.items() if k.startswith(name + "_"))
        return query(spark, sf_dir)

    return of


@pytest.fixture(scope="session")
def oracle():
    def of(name, sf_dir):
        con = duckdb.connect()
        for t in ("documents", "benchmark", "labels", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        cur = con.execute(next(q for k, q in queries.ORACLES.items() if k.startswith(name + "_")))
        return [d[0] for d in cur.description], cur.fetchall()

    return of
