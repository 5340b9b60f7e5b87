"""Carries over ranges of rows: equal to windows over whole groups, whatever the length of a range."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillwork.operators import profile as FP
from quillwork.operators import ranges as G
from quillwork.operators import sheets as X

SCHEMA = "sheet string, row long, col long, line string, seg string, r int"


def rows_of(seed, n=300):
    """A sheet that holds most rows, long and short runs, null sheets, and columns with the names of temporary ones."""
    rng, out, key = random.Random(seed), [], "a"
    for row in range(n):
        if rng.random() < (0.02 if row < n // 2 else 0.5):
            key = rng.choice("abc")
        out += [("big", row, c, f"- {key} - x = {rng.randrange(9)}", "s", 1) for c in range(rng.randrange(3))]
    return out + [(None, i, 1, "no item", None, None) for i in range(5)] + [("one", 7, 1, "- k = v", "", 0), ("nul", None, 1, None, "", 0), ("nul", 1, 1, "z", "", 0)]


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_runs_are_those_of_one_window(spark, size):
    df = spark.createDataFrame(rows_of(size), SCHEMA)
    got = G.runs(df, ["sheet"], "row", ["row", "col", "line"], X.group_key(F.col("line")), size)
    order = Window.partitionBy("sheet").orderBy("row", "col", "line")
    d = df.withColumn("key", X.group_key(F.col("line"))).withColumn("b", F.lag("key").over(order))
    d = d.withColumn("run", F.sum(F.when(F.col("b").isNull() | (F.col("b") != F.col("key")), 1).otherwise(0)).over(order))
    inside = Window.partitionBy("sheet", "run")
    want = d.withColumn("place", F.row_number().over(inside.orderBy("row", "col", "line")).cast("long")).withColumn("run_rows", F.count("*").over(inside))
    assert same(got, want)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_values_carry_over_ranges(spark, size):
    rng = random.Random(size)
    df = spark.createDataFrame([(rng.choice(["a", "b", None]), i, rng.choice([None] * 9 + ["x", "y"]), "o") for i in range(400)], "sheet string, row long, c string, o string")
    down = Window.partitionBy("sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    assert same(G.carry_down(df, ["sheet"], "row", "c", "got", size), df.withColumn("got", F.last("c", True).over(down)))
    assert G.carry_down(df.limit(0), ["sheet"], "row", "c", "got", size).count() == 0


def test_null_keys_are_runs_of_their_own(spark):
    df = spark.createDataFrame([("s", i, k) for i, k in enumerate(["a", "a", None, None, "a"])], "sheet string, row long, k string")
    for size in (1, 2, 10):
        got = G.runs(df, ["sheet"], "row", ["row"], F.col("k"), size).orderBy("row").collect()
        assert [(r.run, r.place, r.run_rows) for r in got] == [(1, 1, 2), (1, 2, 2), (2, 1, 1), (3, 1, 1), (4, 1, 1)]


def test_a_sheet_is_spread_over_tasks(spark):
    """Ranges of one sheet go to different partitions. Spark joins small partitions together and broadcasts small tables, which
    hides that at this size and is switched off here."""
    df = spark.range(10_000).selectExpr("'s' as sheet", "id as row", "1L as col", "concat('- ', id div 90, ' = v') as line")
    off = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        got = X.sections(df, 100).select("section", F.spark_partition_id().alias("p")).collect()
    finally:
        for k in off:
            spark.conf.unset(k)
    held = [sum(r.p == p for r in got) for p in {r.p for r in got}]
    assert len(got) == 10_000 and max(r.section for r in got) == 112 and len(held) == 3 and max(held) < 6_000


def blocks_of(df, key):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r[key]), r.block)):
        out.setdefault(r[key], []).append((r.block, r.start, r.text))
    return out


@pytest.mark.parametrize("budget,size", [(8, 1), (64, 3), (1 << 20, 4096)])
def test_blocks_joined_are_the_document(spark, budget, size):
    rng = random.Random(budget)
    pages = [(d, p, "".join(rng.choice("aé漢😀\n") for _ in range(rng.choice([0, 3, 40, 200])))) for d in (1, 2, 3) for p in range(1, 12)] + [(4, 1, None), (5, 1, ""), (5, 2, None), (None, 1, "x"), (6, None, "first"), (6, 1, "b"), (6, 1, "a")]
    df = spark.createDataFrame(pages, "doc_id long, page_no long, text string")
    got = blocks_of(FP.assemble_blocks(df, "\n--\n", budget=budget, range_rows=size), "doc_id")
    want = {r.doc_id: r.text for r in FP.assemble(df, "\n--\n").collect()}
    assert set(got) == set(want)
    for k, parts in got.items():
        assert "".join(t for _, _, t in parts) == want[k]
        assert [b for b, _, _ in parts] == list(range(len(parts))) and all(len(t.encode()) <= budget for _, _, t in parts)
        assert [s for _, s, _ in parts] == [len("".join(t for _, _, t in parts[:i]).encode()) for i in range(len(parts))]


def test_empty_texts_have_a_block_without_a_separator(spark):
    df = spark.createDataFrame([(1, 1, ""), (1, 2, None)], "doc_id long, page_no long, text string")
    assert [tuple(r) for r in FP.assemble_blocks(df, "").collect()] == [(1, 0, 0, "")]
    assert FP.assemble_blocks(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="8 bytes"):
        FP.assemble_blocks(df, budget=7)


def test_workbook_blocks_are_its_document(spark):
    rows = spark.createDataFrame([("a", 1, 1, "- one"), ("a", 2, 1, "- two " * 30), ("a", None, 2, "- zero"), ("b", 1, 1, "- b"), ("x", 1, 1, "- unused")], "sheet string, row long, col long, line string")
    sheets = spark.createDataFrame([("w", "a", 1), ("w", "blank", 2), ("v", "b", 1), ("v", "a", 2)], "workbook string, sheet string, ordinal int")
    want = {r.workbook: r.text for r in X.sheet_documents(rows, sheets, "T", "now").collect()}
    for budget in (16, 1 << 20):
        got = blocks_of(X.sheet_document_blocks(rows, sheets, "T", "now", budget, 2), "workbook")
        assert {k: "".join(t for _, _, t in v) for k, v in got.items()} == want
