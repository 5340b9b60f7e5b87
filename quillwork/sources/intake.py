"""Intake of a folder of mixed files: tasks open what is asked for, a reader for each kind, and a row for every requested file, failed or
not."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ladder
from ..operators.pages import file_facts
from .document_files import list_document_files, read_document_files
from .workbooks import sheets_of

SHEETS = "array<struct<sheet: string, rows: array<array<string>>>>"
#: One field of a CSV line and what ends it. Quoted runs side by side hold a doubled quote.
FIELD = r'((?:"[^"]*+")++|[^,"]*+)(?:,|\z)'
EMPTY_TABLE = "No columns to parse from file"


def _named(names: DataFrame) -> DataFrame:
    return file_facts(names.select("*", F.col("output_name").alias("path"))).drop("path")


def _once(value: Column, use) -> Column:
    """use(value) with value computed once: the optimiser would copy it to each of its places."""
    return F.element_at(F.transform(F.array(value), use), 1)


def csv_rows(text: Column) -> Column:
    """Rows of fields of CSV text whose records end with their lines; blank lines are skipped, quotes taken off."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda line: F.regexp_replace(line, r"\r\z", "")), lambda line: line != "")
    bare = lambda f: F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)

    def fields(line: Column) -> Column:
        found = F.regexp_extract_all(line, F.lit(FIELD), F.lit(1))
        # at the end of a line whose last field is not empty, the pattern matches once more
        return F.transform(F.when(line.endswith(","), found).otherwise(F.slice(found, 1, F.size(found) - 1)), bare)

    return F.transform(lines, fields)


def broken_line(text: Column) -> Column:
    """The number of the first line with an odd count of quotes, else null."""
    odd = F.transform(F.split(text, "\n"), lambda line: F.regexp_count(line, F.lit('"')) % 2 == 1)
    return F.nullif(F.array_position(odd, True), F.lit(0))


def listing(rows: Column) -> Column:
    """Rows under a header row as text: `- **Row n**` and a line for each value that is not empty."""
    head = F.get(rows, F.lit(0))
    entry = lambda row: F.filter(F.transform(row, lambda v, i: F.when(v != "", F.concat(F.lit("  - **"), F.coalesce(F.nullif(F.get(head, i), F.lit("")), F.concat(F.lit("Value "), (i + 1).cast("string"))), F.lit("**: "), v))), lambda x: x.isNotNull())
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda row, i: F.array_join(F.concat(F.array(F.concat(F.lit("- **Row "), (i + 1).cast("string"), F.lit("**"))), entry(row)), "\n"))
    return F.array_join(body, "\n")


def _workbooks(files: DataFrame) -> DataFrame:
    """output_name, times, size, sheets and problem of workbook files (with content): one of the last two is null; without content both."""

    def read(batches):
        for batch in batches:
            for one in (batch.slice(i, 1) for i in range(batch.num_rows)):
                found, problem, data = None, None, one.column(3)[0].as_py()
                if data is not None:
                    try:
                        found = [{"sheet": name, "rows": rows} for name, rows in sheets_of(data)]
                    except Exception as e:  # any damage of a file is its own row's failure
                        problem = f"Invalid workbook: {type(e).__name__}"
                kind = pa.list_(pa.struct([("sheet", pa.string()), ("rows", pa.list_(pa.list_(pa.string())))]))
                yield pa.RecordBatch.from_arrays([*one.columns[:3], pa.array([found], kind), pa.array([problem], pa.string())], ["output_name", "times", "size", "sheets", "problem"])

    size = F.octet_length("content").cast("long")
    return files.select("output_name", "times", size.alias("size"), "content").mapInArrow(read, f"output_name string, times long, size long, sheets {SHEETS}, problem string")


def _read(asked: DataFrame, path: str, folders: int) -> DataFrame:
    """name, kind, size, success, error, parts and content of the files asked for (output_name, times); `times` rows of each."""
    named, book = _named(asked), F.coalesce(F.col("suffix").isin("xls", "xlsx"), F.lit(False))
    load = lambda some: read_document_files(named.where(some).select("output_name", "times"), path, folders)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    table = lambda t: F.struct(broken_line(t).alias("line"), _once(csv_rows(t), lambda r: F.struct(F.size(r).alias("size"), listing(r).alias("listing"))).alias("rows"))
    plain = _named(load(~book)).withColumn("text", text)
    d = plain.withColumn("csv", F.when(F.col("suffix") == "csv", _once(text, table)))
    # bytes as characters of one byte each: counting never fails on them
    raw = F.when(F.col("kind") == "paged", F.decode("content", "ISO-8859-1"))
    pages = F.regexp_count(raw, F.lit(r"/Type\s*/Page(?![A-Za-z])")).cast("long")
    error = ladder(
        (F.col("kind") == "unsupported", F.concat(F.lit("Unsupported file type: "), "suffix")),
        ((F.col("kind") == "paged") & ~raw.startswith("%PDF-"), "Invalid paged file"),
        ((F.col("kind") != "paged") & F.col("text").isNull(), "Invalid UTF-8"),
        (F.col("csv.line").isNotNull(), F.concat(F.lit("Open quote in line "), F.col("csv.line").cast("string"))),
        (F.col("csv.rows.size") == 0, EMPTY_TABLE),
    )
    content = ladder((F.col("suffix") == "txt", F.concat(F.lit("# "), "title", F.lit("\n\n"), "text")), (F.col("kind") == "text", F.col("text")), (F.col("suffix") == "csv", F.col("csv.rows.listing")))
    out = d.select("output_name", "times", "kind", F.octet_length("content").cast("long").alias("size"), error.alias("error"), F.when(F.col("kind") == "paged", pages).otherwise(1).cast("long").alias("parts"), content.alias("content"))
    filled = F.exists("sheets", lambda s: F.size(s["rows"]) > 0)
    blocks = F.transform("sheets", lambda s: F.concat(F.lit("## Sheet: "), s["sheet"], F.lit("\n\n"), F.when(F.size(s["rows"]) > 1, listing(s["rows"])).otherwise("- *[No data in this sheet]*")))
    sheets = _named(_workbooks(load(book))).select("output_name", "times", "kind", "size", F.coalesce("problem", F.when(~F.coalesce(filled, F.lit(False)), F.lit(EMPTY_TABLE))).alias("error"), F.coalesce(F.size("sheets"), F.lit(0)).cast("long").alias("parts"), F.array_join(blocks, "\n\n").alias("content"))
    missing = F.concat(F.lit("File not found: "), F.coalesce("output_name", F.lit("")))
    both = out.unionByName(sheets).withColumn("error", F.when(F.col("size").isNull(), missing).otherwise(F.col("error")))
    ok = F.col("error").isNull()
    rows = both.select(F.col("output_name").alias("name"), "kind", "size", ok.alias("success"), "error", F.when(ok, F.col("parts")).otherwise(0).cast("long").alias("parts"), F.when(ok, F.col("content")).alias("content"), "times")
    return rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("_again")).drop("times", "_again")


def read_files(spark: SparkSession, path: str, folders: int = 1) -> DataFrame:
    """name, kind, size, success, error, parts and content of every file in a folder.

    Text: Markdown as it is, .txt under a title; CSV and workbooks: listings of their rows under the first, for a workbook below
    `## Sheet:` headings; paged files: the number of pages, no content. Invalid UTF-8, an open quote, bytes that are no workbook
    or no paged file, an empty table and an unknown suffix each give a row with success false and the reason. A file is read by
    one branch only: workbooks, whose reader is Python, are told by their suffix before anything is read. `folders`: as they were
    written by `write_document_files`.
    """
    return _read(list_document_files(spark, path, folders).withColumn("times", F.lit(1).cast("long")), path, folders)


def intake(requested: DataFrame, path: str, folders: int = 1) -> DataFrame:
    """A row as of `read_files` for each requested name; a missing file gives a failed row, no exception. A name asked for twice
    comes twice; files that nobody asked for are left out, and not listed either: tasks open the names that they are given, each
    once, so the driver holds none of them. A null name fails like a missing file."""
    # a stated number of partitions: by bytes, names of many files would share a task
    names = requested.select(F.col("name").alias("output_name")).repartition(int(requested.sparkSession.conf.get("spark.sql.shuffle.partitions")), "output_name")
    return _read(names.groupBy("output_name").agg(F.count("*").alias("times")), path, folders)
