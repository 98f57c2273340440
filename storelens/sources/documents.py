"""Document sources and sinks: S1 folder scan, S2 page assembly, S3 index
save/load, and V8 request attachment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from storelens.functions import windows as W

# Fixed value: the request template used when a PDF is attached (two spaces
# before the second newline, as in the reference).
ATTACH_TEMPLATE_HEAD = "Zawartość pliku PDF załączona przez użytkownika: \n "
ATTACH_TEMPLATE_TAIL = "  \n Pytanie użytkownika: \n"
INDEX_MISSING_MESSAGE = "Błąd backendu. Baza wektorowa niezdefiniowana"

PAGE_SCHEMA = StructType([StructField("doc", StringType()), StructField("page_no", IntegerType()),
                          StructField("text", StringType())])
INDEX_SCHEMA = StructType([StructField("chunk_id", LongType()), StructField("chunk_text", StringType()),
                           StructField("embedding", ArrayType(FloatType()))])


def scan_documents(spark: SparkSession, path: str, extract: Callable[[bytes], list[str | None]],
                   glob: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """Every file in a folder as page rows ``(doc, page_no, text)``.

    Files are read by Spark's ``binaryFile`` source (distributed, one row per
    file); ``extract`` turns one file's bytes into its page texts and runs in
    ``mapInPandas`` next to the data.  The byte decoder is the caller's.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", str(recursive).lower()).load(path)
             .select("path", "content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                for i, text in enumerate(extract(bytes(content))):
                    rows.append((p, i, text))
            yield pd.DataFrame(rows, columns=["doc", "page_no", "text"])

    return files.mapInPandas(run, PAGE_SCHEMA)


def assemble_pages(pages: DataFrame, doc: str = "doc", page_no: str = "page_no", text: str = "text") -> DataFrame:
    """Page texts joined in page order with no separator; null or empty
    pages are skipped; a document whose pages are all empty gives ''."""
    grouped = pages.groupBy(doc).agg(
        F.array_sort(F.collect_list(F.struct(F.col(page_no).alias("p"),
                                             F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("__pages"))
    return grouped.select(doc, F.array_join(F.transform("__pages", lambda x: x["t"]), "").alias("text"))


def page_offsets(pages: DataFrame, doc: str = "doc", page_no: str = "page_no", text: str = "text",
                 bucket_pages: int = 4096) -> DataFrame:
    """S2 without a whole document in one group: each page's text and the place
    ``start`` where it begins in the assembled text.  Sums run per (document,
    bucket of page numbers) and carry over from one summary row per bucket."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = pages.select(doc, page_no, body.alias("page_text"), F.length(body).cast("long").alias("__n"),
                        W.floor_div(F.col(page_no), bucket_pages).alias(W.BUCKET))
    rows = W.running_sum_across(rows, doc, [page_no], "__n", "__end")
    return rows.select(doc, page_no, (F.col("__end") - F.col("__n")).alias("start"), "page_text")


def save_index(index: DataFrame, path: str) -> None:
    """S3: write the index, replacing what was saved at ``path``.

    The caller must not pass a DataFrame that reads ``path`` itself (Spark
    would delete the input before reading it).
    """
    index.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, schema: StructType = INDEX_SCHEMA):
    """S3: ``(index, error)``; a missing or unreadable index gives an empty
    index and the reference's error message instead of raising."""
    try:
        df = spark.read.schema(schema).parquet(path)
        df.limit(1).collect()
        return df, None
    except Exception:  # noqa: BLE001 - any read failure means "no index"
        return spark.createDataFrame([], schema), INDEX_MISSING_MESSAGE


def attach_document(requests: DataFrame, docs: DataFrame, key: str, doc_key: str,
                    request_text: str = "request", file_name: str = "file_name",
                    doc_text: str = "doc_text") -> DataFrame:
    """V8: prefix each request with its attached document's text when the
    file name ends in lower-case ``.pdf``; other attachments are ignored."""
    d = docs.select(F.col(doc_key).alias("__k"), F.col(file_name).alias("__f"), F.col(doc_text).alias("__t"))
    joined = requests.join(d, F.col(key) == F.col("__k"), "left")
    is_pdf = F.coalesce(F.col("__f").endswith(".pdf"), F.lit(False))
    body = F.when(is_pdf, F.concat(F.lit(ATTACH_TEMPLATE_HEAD), F.coalesce("__t", F.lit("")),
                                   F.lit(ATTACH_TEMPLATE_TAIL), F.col(request_text))) \
        .otherwise(F.col(request_text))
    return joined.withColumn(request_text, body).drop("__k", "__f", "__t")
