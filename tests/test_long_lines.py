"""Texts whose one line has 200,000 characters: no operator may fail on them, nor take long."""

import time

import pytest
from pyspark.sql import functions as F

from quillwork.operators import clean as C
from quillwork.operators import evaluate as E
from quillwork.operators import pages as P
from quillwork.operators import profile as FP
from quillwork.operators import quality as Q
from quillwork.operators import routing as R
from quillwork.operators import sheets as X
from quillwork.operators import summary as M

N = 200_000
UNITS = [
    "a", "A", " ", "|", "-", "*", "[", "]", "0", "{", "(", "\n", "Ab ", "a b ", "- | ", "-- ", "|--", "| a ", "*x* ", "**a** [", "1.5 ", "x, ", "[x] ", "¹ ", "prose of plain words ", "A\n", "¤", '"', "$0", ": ", "`", "a@",
]
FRAMES = ["{}", "T{}.x", "** b ** {}x [TBD]", "A row{}", "$ {}, 7", "[x] mark{}y", "1 note{}\nmay{}1 on", "I cannot {}"]


@pytest.fixture(scope="module")
def long_texts(spark):
    rows = [f.replace("{}", (u * (N // len(u) + 1))[: N // f.count("{}")]) for f in FRAMES for u in UNITS]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4).persist()
    assert df.count() == len(rows)
    yield df
    df.unpersist()


def paged(df):
    return df.select("doc_id", F.lit(1).cast("long").alias("page_no"), "text")


OPERATORS = {
    "corruption_score": Q.corruption_score,
    "extraction_strategy": Q.extraction_strategy,
    "clean_commentary": C.clean_commentary,
    "strip_placeholders": C.strip_placeholders,
    "flatten_tables": C.flatten_tables,
    "checkboxes": C.normalise_checkboxes,
    "footnotes": C.footnotes_inline,
    "minimal_footnotes": lambda df: C.footnotes_inline(df, style="minimal"),
    "page_analysis": R.analyse_pages,
    "visual_replies": lambda df: R.parse_visual(df.withColumnRenamed("text", "response")),
    "ratings": lambda df: E.parse_ratings(df.withColumnRenamed("text", "response")),
    "missing_items": lambda df: E.missing_items(df.withColumn("formatted", F.upper("text"))),
    "content_profile": FP.content_profile,
    "document_structure": lambda df: FP.document_structure(paged(df)),
    "simple_documents": lambda df: FP.simple_documents(paged(df)),
    "chunk_plan": lambda df: FP.chunk_plan(paged(df)),
    "consistency": lambda df: FP.consistency_score(df, "text"),
    "table_format": lambda df: FP.table_format(df, "text"),
    "reject_reason": P.reject_reason,
    "keyword_lines": M.keyword_lines,
    "paragraph_rank": M.paragraph_rank,
    "smart_truncate": lambda df: M.smart_truncate(df, 5000),
    "cells": lambda df: df.select(X.format_value(F.col("text"), F.lit("numeric")).alias("v"), X.is_date(F.col("text")).alias("d"), X.is_category(F.col("text")).alias("c"), X.group_key(F.col("text")).alias("g")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_takes_long_lines(long_texts, name):
    began = time.time()
    OPERATORS[name](long_texts).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 60


def test_a_line_is_told_to_be_a_row_once(spark):
    """Rows are told apart once a line: 20,000 lines of a table would be tried again for each of them."""
    text = "head\n" + "\n".join(["| a | b |"] * 20_000) + "\nx | y\n| c | d |"
    began = time.monotonic()
    got = C.table_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 20_000, 20_000), (1, 20_002, 20_002, 1)] and time.monotonic() - began < 60
