"""File sources and sinks: text, CSV, binary listings; Markdown, JSON and log tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip, text_of


def shared_folder(spark: SparkSession) -> str:
    """A new folder for written tables, below spark.checkpoint.dir; a local session without it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each text file, whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size and time of each file; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table with a header, all values as strings, nulls as ''. Without a schema types are not inferred, which saves a pass."""
    reader = spark.read.option("header", True).option("multiLine", False)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def output_name(stem: Column, stamp: Column, suffix: str = ".md", kind: str = "") -> Column:
    """`{stem}{kind}_{yyyymmdd_HHMMSS}.md`; the time is given, never read from a clock."""
    safe = F.regexp_replace(strip(stem), r"[^\p{L}\p{N}_.-]+", "_")
    return F.concat(safe, F.lit(kind + "_"), F.date_format(stamp, "yyyyMMdd_HHmmss"), F.lit(suffix))


def write_documents(docs: DataFrame, path: str) -> None:
    """Processed documents (output_name, content) as Parquet: at scale a table of documents, not a file for each."""
    docs.select("output_name", "content").write.parquet(path)


def write_json(results: DataFrame, path: str) -> None:
    """results, one JSON object a line; nulls are left out, an empty table writes no rows."""
    results.write.json(path)


def page_log(pages: DataFrame) -> DataFrame:
    """Log rows of pages (ts, page_no, method, seconds, from_cache): ts, level and message."""
    source = F.when(F.col("from_cache"), " (cached)").otherwise("")
    said = F.concat(F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] page "), F.col("page_no").cast("string"), F.lit(" via "), text_of("method"), F.lit(" in "), F.col("seconds").cast("string"), F.lit(" s"), source)
    return pages.select("ts", F.when(F.col("seconds") > 50, "warning").otherwise("info").alias("level"), said.alias("message"))
