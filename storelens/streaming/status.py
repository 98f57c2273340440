"""S4 as a stream: status lines arriving as text files.

Parsing is stateless, so the batch parser applies to the stream unchanged;
each line keeps the file it came from (one file per request stream).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from storelens.operators.status import parse_status_lines
from storelens.sources.growing_lines import GrowingLines


def status_line_stream(spark: SparkSession, folder: str, glob: str = "*.jsonl",
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Parsed status lines ``(source_file, line, type, data, data_kind)`` from
    line-delimited JSON files arriving in ``folder``."""
    reader = spark.readStream.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.text(folder).select(F.col("_metadata.file_path").alias("source_file"),
                                       F.col("value").alias("line"))
    return parse_status_lines(lines)


def growing_status_lines(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame:
    """As ``status_line_stream`` for files that are still being appended to: each line comes once, when it is
    whole, with the byte ``at`` which it begins; an unterminated last line waits for its line break."""
    spark.dataSource.register(GrowingLines)
    lines = spark.readStream.format("growing_lines").option("path", folder).option("glob", glob).load()
    return parse_status_lines(lines.withColumnRenamed("path", "source_file"))
