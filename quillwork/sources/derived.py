"""Derived input tables: documents with one planted block each, their pages, and per-page tables that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_of

LINES_PER_PAGE = 5
#: The block appended to a document with doc_id mod 16 = k.
BLOCKS = [
    "",
    "",
    "| Plan | PCP | ER |\n|---|---|---|\n| Gold | $10 | $50 |\n| Silver | $20 |  |",
    "Quarter    Revenue    Profit\nQ1 2024    $50,000    $20,000",
    "[x] Medical\n[ ] Dental\n☑ Vision",
    "I apologize for the confusion. Here is the extracted text.\nIf you have any questions, feel free to ask.",
    "**Deductible**: [TBD]\n- [N/A]\n**Copay**: $25 [Pending] review",
    "Coverage starts in May[1].\n1 Subject to eligibility, see plan. Second sentence.",
    "Total due $100,5 today\n✓ approved",
    "a b c d e f g h a b c d e f g h a b c d e f g h a b c d e f g h a b c d e f g h a b c d e f g h a b c d e f g h",
    "gnidliub noitacol ynapmoc ecnarusni gnidliub noitacol ynapmoc ecnarusni gnidliub noitacol ynapmoc ecnarusni",
    "�� ¤¤ §§ �� ¤¤ §§ �� ¤¤ §§ �� ¤¤ §§ �� ¤¤ §§ �� ¤¤ §§ �� ¤¤ §§",
    "\nBenefit coverage is 80% up to $500 for eligible members.\n\nA plain paragraph follows the benefit paragraph.",
    "- item one\n- item two\n1. first\n2. second",
    "--------    --------\n======",
    "[Page 3: No text could be extracted]",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def augmented(documents: DataFrame) -> DataFrame:
    """doc_id and text of every document, with its planted block on new lines. A null text counts as empty."""
    k = F.pmod(F.col("doc_id"), F.lit(16)).cast("int")
    block = F.element_at(F.array(*[F.lit(b) for b in BLOCKS]), k + 1)
    return documents.select("doc_id", F.when(block == "", text_of()).otherwise(F.concat(text_of(), F.lit("\n"), block)).alias("text"))


def paged(docs: DataFrame) -> DataFrame:
    """doc_id, page_no (from 1) and text: five lines a page."""
    lines = F.split("text", "\n")
    starts = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / LINES_PER_PAGE).cast("int"))
    pages = F.transform(starts, lambda p: F.array_join(F.slice(lines, p * LINES_PER_PAGE + 1, LINES_PER_PAGE), "\n"))
    return docs.select("doc_id", F.posexplode(pages).alias("p", "text")).select("doc_id", (F.col("p") + 1).cast("long").alias("page_no"), "text")


def docs_aug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augmented(read(spark, sf_dir, "documents"))


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paged(docs_aug(spark, sf_dir))


def page_specs(docs: DataFrame) -> DataFrame:
    """A page-range spec for each document, by its id."""
    specs = F.array(*[F.lit(x) for x in ("", "1", "1-2", "1, 3", "99", "a-b")])
    return docs.select("doc_id", F.element_at(specs, F.pmod(F.col("doc_id"), F.lit(6)).cast("int") + 1).alias("spec"))


def page_settings(docs: DataFrame) -> DataFrame:
    """Raw user settings of every third document: page 1 yes, page 2 NO, page 3 not valid; one page number is no number."""
    rows = F.array(*[F.struct(F.lit(p).alias("page_no"), F.lit(v).alias("setting")) for p, v in (("1", " yes"), ("2", "NO"), ("3", "maybe"), ("x", "YES"))])
    return docs.where("doc_id % 3 = 0").select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.page_no", "r.setting")


def attempts(pages: DataFrame) -> DataFrame:
    """Three extraction attempts of each page; success and content follow from ids."""
    rows = pages.select("doc_id", "page_no", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("attempt"), "text")
    rows = rows.withColumn("method", F.when(F.col("attempt") < 3, "vision").otherwise("tesseract"))
    rows = rows.withColumn("success", (F.col("doc_id") + F.col("page_no") * 3 + F.col("attempt") * 2) % 7 < 2)
    return rows.select("doc_id", "page_no", "attempt", "method", "success", F.when(F.col("success"), F.concat(F.lit("v"), F.col("attempt").cast("string"), F.lit(": "), F.col("text"))).alias("content"), F.when(F.col("success"), F.length("text")).otherwise(0).cast("long").alias("tokens"), F.when(~F.col("success"), F.element_at(F.array(F.lit("Request timeout"), F.lit("Rate limit hit"), F.lit("Bad gateway")), ((F.col("doc_id") + F.col("page_no")) % 3 + 1).cast("int"))).alias("error"))


def visual_flags(pages: DataFrame) -> DataFrame:
    """Visual analysis of two pages in five, by ids; others have none."""
    k = (F.col("doc_id") * 3 + F.col("page_no")) % 5
    m = (F.col("doc_id") + F.col("page_no")) % 4
    has = k < 2
    return pages.withColumn("v_tables", F.when(has, m == 0)).withColumn("v_charts", F.when(has, m == 1)).withColumn("v_forms", F.when(has, F.lit(False))).withColumn("v_layout", F.when(has, F.when(m == 2, "complex").otherwise("simple"))).withColumn("v_image", F.when(has, F.when(m == 3, "poor").otherwise("good")))


def page_metrics(pages: DataFrame) -> DataFrame:
    """Counts of a raw web page: text without tags, images (one page in five), drawings (lists) and text blocks."""
    html = F.coalesce("html", F.lit(""))
    count = lambda p: F.regexp_count(html, F.lit(p)).cast("long")
    return pages.select("page_id", F.length(F.regexp_replace(html, "<[^>]*>", "")).cast("long").alias("text_len"), F.when(F.col("page_id") % 5 == 0, 1).otherwise(0).cast("long").alias("images"), count("<ul").alias("drawings"), (count("<p") + count("<li")).alias("blocks"))


def task_config(spark: SparkSession) -> DataFrame:
    """The task dimension: five rows."""
    rows = [("main", "m-large", "a", 0.1, 4000), ("vision", "m-vision", "b", 0.0, 4096), ("formatting", "m-large", "a", 0.2, 16000), ("evaluation", "m-judge", "c", 0.0, 2000), ("summary", "m-small", None, 0.3, 1500)]
    return spark.createDataFrame(rows, "task string, model string, provider string, temperature double, max_tokens long")


#: Rows of a derived worksheet: parts and suppliers go on in a next sheet.
SHEET_ROWS = 100


def _unpivoted(df: DataFrame, sheet: Column, row: Column, columns: list) -> DataFrame:
    values = F.array(*[F.struct(F.lit(i).cast("long").alias("col"), c.cast("string").alias("value")) for i, c in enumerate(columns, 1)])
    return df.select(sheet.alias("sheet"), row.cast("long").alias("row"), F.explode(values).alias("x")).select("sheet", "row", "x.col", "x.value")


#: Header cells of the derived worksheets: (row, values) of each kind.
HEADERS = {"nation": [(1, ("Region", "Nation", "Figures", None, "Active")), (2, (None, None, "Amount", "Share", None))], "part": [(1, ("Item", "Brand", "Kind", "Size", "Price", "Made"))], "supplier": [(1, ("Supplier", "Nation", "Level"))]}
#: Merged rectangles: a header over two columns, and regions of five nations each.
MERGED = [("nation", 1, 3, 1, 4), *[("nation", 3 + 5 * r, 1, 7 + 5 * r, 1) for r in range(5)]]


def _sheets(df: DataFrame, kind: str, key: str, columns: list) -> DataFrame:
    """Worksheets `kind_0`, `kind_1` and so on of SHEET_ROWS keys each, under their header."""
    sheet = F.concat(F.lit(f"{kind}_"), F.floor(F.col(key) / SHEET_ROWS).cast("string"))
    body = _unpivoted(df, sheet, F.col(key) % SHEET_ROWS + 2, columns)
    sheets = df.select(sheet.alias("sheet")).distinct()
    for row, values in HEADERS[kind]:
        body = body.unionByName(_unpivoted(sheets, F.col("sheet"), F.lit(row), [F.lit(v) for v in values]))
    return body


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worksheets in long form: nations under their merged regions, parts and suppliers."""
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n, place = F.col("n_nationkey"), F.col("n_regionkey") * 5 + F.floor(F.col("n_nationkey") / 5)
    nations = _unpivoted(nation, F.lit("nation"), place + 3, [F.when(F.floor(n / 5) == 0, F.col("r_name")), F.col("n_name"), F.concat(F.lit("$"), (n * 1000).cast("string"), F.lit(".5")), F.concat(n.cast("string"), F.lit("%")), F.when(n % 3 == 0, "yes").otherwise("no")])
    key = F.col("p_partkey")
    part = _sheets(read(spark, sf_dir, "part"), "part", "p_partkey", [F.col("p_name"), F.col("p_brand"), F.when(key % 4 != 0, F.col("p_type")), F.col("p_size"), F.concat(F.lit("$"), (F.col("p_size") * 100).cast("string"), F.lit("/lot")), F.concat_ws("/", (key % 12 + 1).cast("string"), (key % 28 + 1).cast("string"), F.lit("24"))])
    supplier = _sheets(read(spark, sf_dir, "supplier"), "supplier", "s_suppkey", [F.col("s_name"), F.col("s_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey") * 1250).otherwise(0)])
    heads = spark.createDataFrame([("nation", r, c, v) for r, vs in HEADERS["nation"] for c, v in enumerate(vs, 1)], "sheet string, row long, col long, value string")
    return heads.unionByName(nations).unionByName(part).unionByName(supplier)


def workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workbook, sheet and ordinal: a workbook for each sheet of parts, between the nations and a blank sheet."""
    books = read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / SHEET_ROWS).cast("string").alias("k")).distinct()
    sheets = F.array(F.lit("nation"), F.concat(F.lit("part_"), "k"), F.lit("blank"))
    return books.select(F.concat(F.lit("w"), "k").alias("workbook"), F.posexplode(sheets).alias("i", "sheet")).select("workbook", "sheet", (F.col("i") + 1).alias("ordinal"))


def merged(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MERGED, "sheet string, min_row long, min_col long, max_row long, max_col long")
