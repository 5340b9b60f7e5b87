"""Worksheets as long cell tables (sheet, row, col, value; 1-based): headers, column profiles, flattened facts, sections.

What depends on the order of a sheet's rows is carried over ranges of rows (`ranges.py`); no window holds a sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import flag, joined, ladder, once, strip, text_of, title_case
from .ranges import RANGE_ROWS, carry_down, plain_columns, range_of, runs, text_blocks

#: Date patterns, acronyms and sizes.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATES = (r"^[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}$", r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}$", rf"(?i)^({MONTHS})", rf"(?i)^[0-9]{{1,2}}-({MONTHS})")
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
ACRONYMS = ("VSP", "UHC", "PPO", "HMO", "COBRA")
SECTION_LINES = 18
HEADER_ROWS = 3


def value_of(name: str = "value") -> Column:
    return strip(text_of(name))


def is_numeric(value: Column) -> Column:
    return strip(F.translate(value, ",$%()", "")).rlike(NUMBER)


def is_date(value: Column) -> Column:
    out: Column = F.lit(False)
    for p in DATES:
        out = out | strip(value).rlike(p)
    return out


def is_category(value: Column) -> Column:
    v = strip(value)
    return (v != "") & (F.length(v) <= 50) & ~is_numeric(v) & (F.size(F.split(v, r"\s+")) <= 5) & ~v.rlike(r"^[0-9]{2,4}[-/][0-9]{1,2}[-/][0-9]{1,4}$") & ~v.rlike(r"^[0-9]{5,}$")


def merged_fill(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """cells with every cell of a merged rectangle (min_row, min_col, max_row, max_col) holding its top-left value.

    Rectangles are expanded to cells and joined by key; overlapping rectangles give the one that starts first.
    """
    spots = merged.select("sheet", "min_row", "min_col", F.explode(F.sequence("min_row", "max_row")).alias("row"), "max_col").select("sheet", "min_row", "min_col", "row", F.explode(F.sequence("min_col", "max_col")).alias("col"))
    spots = spots.groupBy("sheet", "row", "col").agg(F.min(F.struct("min_row", "min_col")).alias("o"))
    top = cells.select("sheet", F.col("row").alias("r"), F.col("col").alias("c"), F.col("value").alias("top"))
    filled = spots.join(top, (spots["sheet"] == top["sheet"]) & (F.col("o.min_row") == F.col("r")) & (F.col("o.min_col") == F.col("c")), "left").select(spots["sheet"], "row", "col", "top", F.lit(True).alias("_in"))
    return cells.join(filled, ["sheet", "row", "col"], "full").select("sheet", "row", "col", F.when(F.col("_in"), F.col("top")).otherwise(F.col("value")).alias("value"))


def header_rows(cells: DataFrame) -> DataFrame:
    """sheet, header_rows, data_start (a row number), multi_level: of the first three rows, the first is a header if it has a
    value; a later one is data if over a quarter of its values look like data, and ends the header."""
    v = value_of()
    data = is_numeric(v) | v.contains(":") | v.contains("%") | F.lower(v).isin("yes", "no")
    rows = cells.where(F.col("row") <= HEADER_ROWS).groupBy("sheet", "row").agg(F.sum((v != "").cast("long")).alias("n"), F.sum(((v != "") & data).cast("long")).alias("d"))
    start = F.when((F.col("row") > 1) & (F.col("n") > 0) & (F.col("d") * 4 > F.col("n")), F.col("row"))
    first = rows.groupBy("sheet").agg(F.min(start).alias("cut"))
    kept = rows.join(first, "sheet").where((F.col("n") > 0) & (F.col("cut").isNull() | (F.col("row") < F.col("cut"))))
    d = first.join(kept.groupBy("sheet").agg(F.count("*").alias("header_rows")), "sheet", "left").na.fill(0, ["header_rows"])
    return d.select("sheet", "header_rows", F.coalesce(F.col("cut").cast("long"), F.col("header_rows") + 1).alias("data_start"), (F.col("header_rows") > 1).alias("multi_level"))


def header_rows_legacy(cells: DataFrame) -> DataFrame:
    """sheet, header_rows: leading rows, of the first ten, in which over half of the row's width is text."""
    v = value_of()
    rows = cells.where("row <= 10").groupBy("sheet", "row").agg(F.max("col").alias("w"), F.sum(((v != "") & ~is_numeric(v)).cast("long")).alias("t"))
    stop = rows.groupBy("sheet").agg(F.min(F.when(F.col("t") * 2 <= F.col("w"), F.col("row"))).alias("stop"), F.max("row").alias("last"))
    return stop.select("sheet", F.coalesce(F.col("stop") - 1, F.col("last")).cast("long").alias("header_rows"))


def header_names(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """sheet, col, header: a column's header values from top to bottom, joined by ` - `, none that repeats the one before it;
    without any, Column and its number."""
    own = cells.join(headers.select("sheet", "data_start"), "sheet").withColumn("v", value_of())
    cols = own.select("sheet", "col").distinct()
    tops = own.where((F.col("row") < F.col("data_start")) & (F.col("v") != ""))
    fresh = tops.withColumn("b", F.lag("v").over(Window.partitionBy("sheet", "col").orderBy("row"))).where("b is null or b <> v")
    named = fresh.groupBy("sheet", "col").agg(joined(F.struct(F.col("row").alias("pos"), F.col("v").alias("value")), " - ").alias("header"))
    return cols.join(named, ["sheet", "col"], "left").withColumn("header", F.coalesce("header", F.concat(F.lit("Column"), F.col("col").cast("string"))))


def column_profiles(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """sheet, col, n_samples, type, role from a column's first five data values. A text column among the first five whose
    samples are under 100 characters is a label."""
    own = cells.join(headers.select("sheet", "data_start"), "sheet").withColumn("v", value_of())
    cols = own.select("sheet", "col").distinct()
    data = own.where((F.col("row") >= F.col("data_start")) & (F.col("v") != "")).withColumn("n", F.row_number().over(Window.partitionBy("sheet", "col").orderBy("row"))).where("n <= 5")
    v = F.col("v")
    small = F.when(is_numeric(F.replace(v, F.lit("%"), F.lit(""))), F.translate(v, "%", "").try_cast("double") <= 100)
    d = data.groupBy("sheet", "col").agg(F.count("*").alias("n_samples"), F.min(is_numeric(v)).alias("num"), F.min(v.contains("$") | is_numeric(v)).alias("cur"), F.min(v.contains("%") | flag(small)).alias("pct"), F.sum(is_date(v).cast("long")).alias("dates"), F.max(F.length(v)).alias("longest"))
    d = cols.join(d, ["sheet", "col"], "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))
    d = d.withColumn("type", ladder((F.col("n_samples") == 0, "empty"), (F.col("num"), "numeric"), (F.col("cur"), "currency"), (F.col("pct"), "percentage"), (F.col("dates") * 2 > F.col("n_samples"), "date"), otherwise="text"))
    label = (F.col("type") == "text") & (F.col("longest") < 100) & (F.col("col") <= 5)
    return d.select("sheet", "col", "n_samples", "type", F.when(label, F.concat(F.lit("label_"), F.col("col").cast("string"))).otherwise("data").alias("role"))


def structure_confidence(headers: DataFrame, profiles: DataFrame) -> DataFrame:
    """sheet, confidence: a half, with header rows and typed columns more."""
    n = profiles.groupBy("sheet").agg(F.count("*").alias("n"))
    return headers.join(n, "sheet").select("sheet", ((5 + F.when(F.col("header_rows") > 0, 2).otherwise(0) + F.when(F.col("n") > 0, 2).otherwise(0) + 1) / 10).alias("confidence"))


def hierarchy_flag(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """sheet, filled, rows, hierarchical (the first column is filled in under 70 % of the first ten data rows) and repeats (under
    half of its values are distinct)."""
    first = cells.where("col = 1").join(headers.select("sheet", "data_start"), "sheet").where(F.col("row").between(F.col("data_start"), F.col("data_start") + 9)).withColumn("v", value_of())
    d = first.groupBy("sheet").agg(F.sum((F.col("v") != "").cast("long")).alias("filled"), F.count("*").alias("rows"), F.count_distinct(F.when(F.col("v") != "", F.col("v"))).alias("kinds"))
    return d.select("sheet", "filled", "rows", (F.col("filled") * 10 < F.col("rows") * 7).alias("hierarchical"), (F.col("kinds") * 2 < F.col("rows")).alias("repeats"))


def format_value(value: Column, kind: Column) -> Column:
    """A value by its type: $1,234.50, 5.00%, 1,234.5; what cannot be read stays as it is."""

    def shown(v: Column) -> Column:
        money, share, plain = strip(F.translate(v, "$,", "")), strip(F.translate(v, "%", "")), strip(F.translate(v, ",", ""))
        number = lambda c: F.when(c.rlike(NUMBER), c.try_cast("double"))
        m, s, p = number(money), number(share), number(plain)
        as_money = F.when(m >= 0, F.concat(F.lit("$"), F.format_number(m, 2))).otherwise(F.concat(F.lit("-$"), F.format_number(-m, 2)))
        decimals = F.length(F.substring_index(plain, ".", -1))
        fraction = F.concat(F.format_number(F.when(p < 0, F.ceil(p)).otherwise(F.floor(p)), 0), F.lit("."), F.substring_index(plain, ".", -1))
        fraction = F.when((p < 0) & (p > -1), F.concat(F.lit("-"), F.regexp_replace(fraction, "^-", ""))).otherwise(fraction)
        # -0 is shown as 0, as an integer has no sign there
        as_number = F.when(p == 0, F.lit("0")).when(p == F.floor(p), F.format_number(p, 0)).when(plain.contains(".") & (decimals > 0), fraction).otherwise(plain)
        return ladder(
            (v == "", ""),
            ((kind == "currency") | v.contains("$"), F.coalesce(F.when(m.isNotNull(), as_money), v)),
            (v.contains("%"), F.coalesce(F.when(s.isNotNull(), F.concat(F.format_number(s, 2), F.lit("%"))), v)),
            (kind == "percentage", F.coalesce(F.when(number(v).isNotNull(), F.concat(F.format_number(number(v) * 100, 2), F.lit("%"))), v)),
            ((kind == "numeric") | is_numeric(v), F.coalesce(F.when(p.isNotNull(), as_number), v)),
            otherwise=v,
        )

    return once(strip(F.coalesce(value, F.lit(""))), shown)


def label_unpivot(cells: DataFrame, headers: DataFrame, names: DataFrame, profiles: DataFrame) -> DataFrame:
    """sheet, row, col, line: `- labels - header = value` for each data cell that is not empty, in rows with a label."""
    own = cells.join(headers.select("sheet", "data_start"), "sheet").where(F.col("row") >= F.col("data_start")).join(profiles.select("sheet", "col", "type", "role"), ["sheet", "col"]).withColumn("v", value_of()).where("v <> ''")
    labels = own.where(F.col("role").startswith("label")).groupBy("sheet", "row").agg(joined(F.struct(F.col("col").alias("pos"), F.col("v").alias("value")), " - ").alias("labels"))
    data = own.where("role = 'data'").join(labels, ["sheet", "row"]).join(names, ["sheet", "col"])
    return data.select("sheet", "row", "col", F.concat(F.lit("- "), "labels", F.lit(" - "), "header", F.lit(" = "), format_value(F.col("v"), F.col("type"))).alias("line"))


def hierarchical_rows(cells: DataFrame, headers: DataFrame, names: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """sheet, row, col, line with a category of column 1 that carries down: `- category: sub - header = value`; a row without a
    sub takes the category alone. Empty and zero values give no line. Categories are carried over ranges of `range_rows` rows, so
    no task holds a sheet."""
    own = cells.join(headers.select("sheet", "data_start"), "sheet").where(F.col("row") >= F.col("data_start")).withColumn("v", value_of())
    keys = own.where("col <= 2").groupBy("sheet", "row").agg(F.max(F.when(F.col("col") == 1, F.nullif("v", F.lit("")))).alias("c"), F.max(F.when(F.col("col") == 2, F.nullif("v", F.lit("")))).alias("sub"))
    keys = carry_down(keys, ["sheet"], "row", "c", "category", range_rows).withColumn("id", F.concat_ws(": ", "category", "sub")).where("id <> ''")
    data = own.where("col > 2").where(~F.col("v").isin("", "0", "0.0", "nan")).join(keys, ["sheet", "row"]).join(names, ["sheet", "col"])
    return data.select("sheet", "row", "col", F.concat(F.lit("- "), "id", F.lit(" - "), "header", F.lit(" = "), "v").alias("line"))


def flat_rows(cells: DataFrame, headers: DataFrame, names: DataFrame, profiles: DataFrame) -> DataFrame:
    """sheet, row, col, line: `- id - header: value` with a text column 1 as id, else `- header: value`."""
    own = cells.join(headers.select("sheet", "data_start"), "sheet").where(F.col("row") >= F.col("data_start")).withColumn("v", value_of()).where("v <> ''")
    ids = own.where("col = 1").join(profiles.where("col = 1 and type = 'text'").select("sheet"), "sheet").select("sheet", "row", F.col("v").alias("id"))
    data = own.join(ids, ["sheet", "row"], "left").where("id is null or col > 1").join(names, ["sheet", "col"])
    return data.select("sheet", "row", "col", F.concat(F.lit("- "), F.coalesce(F.concat("id", F.lit(" - ")), F.lit("")), "header", F.lit(": "), "v").alias("line"))


def group_key(line: Column) -> Column:
    """The first three parts of what stands left of ` = ` (or of `: `) in a `- ` line; other lines are misc."""
    body = F.substring(line, F.lit(3), F.length(line))
    left = F.when(body.contains(" = "), F.substring_index(body, " = ", 1)).otherwise(F.substring_index(body, ": ", 1))
    return F.when(line.startswith("- "), F.array_join(F.slice(F.split(left, " - "), 1, 3), " - ")).otherwise("misc")


def section_title(key: Column) -> Column:
    """A key without `Employee Only - `, acronyms in upper case, Buy-Up, other parts in title case; misc is a Data Section."""
    bare = F.when(key == "misc", "Data Section").when(key.startswith("Employee Only - "), F.substring(key, F.lit(17), F.length(key))).otherwise(key)
    part = lambda p: F.when(F.upper(p).isin(*ACRONYMS), F.upper(p)).when(F.lower(p).isin("buy-up", "buy up"), "Buy-Up").otherwise(title_case(p))
    return F.array_join(F.transform(F.split(bare, " - "), part), " - ")


def sections(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Lines (sheet, row, col, line) with key, section (runs of equal keys, from 1), part and title: parts of 18 lines, 19 for a
    sheet's first. Runs are told over ranges of `range_rows` rows, so no task holds a sheet. Null lines are misc; rows with equal places
    are ordered by their lines."""
    own = rows.select(F.struct("*").alias("line_row"), "sheet", "row", "col", "line")
    d = runs(own, ["sheet"], "row", ["row", "col", "line"], group_key(F.col("line")), range_rows)
    first = F.when(F.col("run") == 1, 1).otherwise(0)
    part = lambda n: F.when(n <= SECTION_LINES + first, 1).otherwise(F.ceil((n - first) / SECTION_LINES)).cast("long")
    title = F.concat(section_title(F.col("key")), F.when(part(F.col("run_rows")) > 1, F.concat(F.lit(" (Part "), part(F.col("place")).cast("string"), F.lit(")"))).otherwise(""))
    return d.select(*plain_columns(rows, ("key", "section", "part", "title"), "line_row"), "key", F.col("run").alias("section"), part(F.col("place")).alias("part"), title.alias("title"))


def sheet_documents(rows: DataFrame, sheets: DataFrame, title: str, processed: str) -> DataFrame:
    """workbook text: a header, then each sheet (sheet, ordinal) with its lines in order; empty sheets say so. The time of
    processing is given."""
    body = rows.groupBy("sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "line"))), lambda x: x["line"]), "\n").alias("body"))
    d = sheets.join(body, "sheet", "left").withColumn("value", F.concat(F.lit("## Sheet: "), "sheet", F.lit("\n\n"), F.coalesce("body", F.lit("- *[No data in this sheet]*"))))
    head = F.concat(F.lit(f"# {title}\n\nProcessed: {processed}\nSheets: "), F.count("*").cast("string"), F.lit("\n\n---\n\n"))
    return d.groupBy("workbook").agg(F.concat(head, joined(F.struct(F.col("ordinal").alias("pos"), "value"), "\n\n")).alias("text"))


def sheet_document_blocks(rows: DataFrame, sheets: DataFrame, title: str, processed: str, budget: int = 1 << 20, range_rows: int = RANGE_ROWS) -> DataFrame:
    """workbook, block, start and text: the texts of `sheet_documents` as ordered blocks of at most `budget` bytes, however long a
    workbook is. Null lines are left out; a sheet without rows says so."""
    head = F.concat(F.lit(f"# {title}\n\nProcessed: {processed}\nSheets: "), F.count("*").cast("string"), F.lit("\n\n---"))
    none = F.lit(None).cast("long")
    place = lambda o, r, c, t: [o.cast("long").alias("ordinal"), r.cast("long").alias("row"), c.cast("long").alias("col"), t.alias("text")]
    heads = sheets.groupBy("workbook").agg(head.alias("head")).select("workbook", *place(none, none, none, F.col("head")))
    titles = sheets.select("workbook", *place(F.col("ordinal"), none, none, F.concat(F.lit("\n\n## Sheet: "), "sheet", F.lit("\n"))))
    # a filter on lines would compute their long expressions a second time
    body = sheets.join(rows.select("sheet", "row", "col", "line", F.lit(True).alias("found")), "sheet", "left")
    said = F.when(F.col("found"), F.coalesce(F.concat(F.lit("\n"), "line"), F.lit(""))).otherwise("\n- *[No data in this sheet]*")
    body = body.select("workbook", *place(F.col("ordinal"), F.coalesce("row", F.lit(-1)), F.coalesce("col", F.lit(-1)), said))
    pieces = heads.unionByName(titles).unionByName(body)
    part = F.struct("ordinal", range_of("row", range_rows).alias("range"))
    return text_blocks(pieces, ["workbook"], part, ["ordinal", "row", "col"], budget=budget)


def sheet_union(per_sheet: DataFrame, config: DataFrame) -> DataFrame:
    """Lines of all sheets in the order of their saved config (the last saved of a sheet counts) under `## {sheet}`; a sheet
    without lines gives a marker line."""
    last = config.withColumn("_n", F.row_number().over(Window.partitionBy("sheet").orderBy(F.desc("saved")))).where("_n = 1")
    heads = last.select("ordinal", "sheet", F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col"), F.concat(F.lit("## "), "sheet").alias("line"))
    body = last.select("ordinal", "sheet").join(per_sheet.select("sheet", F.col("row").cast("long"), F.col("col").cast("long"), "line"), "sheet", "left")
    body = body.select("ordinal", "sheet", F.coalesce("row", F.lit(1)).alias("row"), F.coalesce("col", F.lit(1)).alias("col"), F.coalesce("line", F.concat(F.lit("*[Failed to process sheet "), "sheet", F.lit("]*"))).alias("line"))
    return heads.unionByName(body)


def workbook_stats(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: sheets, columns of the widest, filled cells, lines, and the mean of sheets' confidences from their lines."""
    c = cells.groupBy("sheet").agg(F.max("col").alias("cols"), F.sum((value_of() != "").cast("long")).alias("filled"))
    n = rows.groupBy("sheet").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"), F.max(F.col("line").contains(" - ") & F.col("line").contains(" = ")).alias("marked"))
    d = c.join(n, "sheet", "left").na.fill(0, ["lines", "chars"])
    conf = 5 + F.when(F.col("chars") > 100, 2).otherwise(0) + F.when(flag(F.col("marked")), 2).otherwise(0) + F.when(F.col("lines") > 0, 1).otherwise(0)
    return d.agg(F.count("*").alias("sheets"), F.max("cols").cast("long").alias("max_columns"), F.sum("filled").alias("filled"), F.sum("lines").alias("lines"), (F.sum(conf) / F.count("*") / 10).alias("confidence"))


def content_confidence(text: Column) -> Column:
    """Confidence of a converted text by its length, markers and digits, in 0.1 to 1; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    points = F.lit(90) - F.when(F.length(t) < 100, 30).when(F.length(t) < 500, 10).otherwise(0) + F.when(t.contains("- **"), 5).otherwise(0) + F.when(t.contains("## Sheet:"), 5).otherwise(0) - F.when(t.rlike(r"\p{Nd}"), 0).otherwise(20)
    return F.greatest(F.lit(10), F.least(F.lit(100), points)) / 100


def formatting_confidence(text: Column, hierarchical: Column) -> Column:
    """Confidence of formatted lines: length, the marks of labelled values, data lines, and whether the hierarchy is known."""
    t = F.coalesce(text, F.lit(""))
    points = F.lit(5) + F.when(F.length(t) > 100, 2).otherwise(0) + F.when(t.contains(" - ") & t.contains(" = "), 2).otherwise(0) + F.when(t.rlike(r"(?m)^[\t ]*- "), 1).otherwise(0) + F.when(hierarchical.isNotNull(), 1).otherwise(0)
    return F.least(F.lit(10), points) / 10


def workbook_confidence(sheets: DataFrame) -> DataFrame:
    """workbook and confidence from its sheets (rows, chars): empty sheets, a short result and few rows lower it; without rows it is
    0.1. Null rows and chars count as 0."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    d = sheets.groupBy("workbook").agg(F.count("*").alias("sheets"), F.sum(F.when(n("rows") == 0, 1).otherwise(0)).alias("empty"), F.sum(n("rows")).alias("rows"), F.sum(n("chars")).alias("chars"))
    lost = F.col("empty") * 3 / (F.col("sheets") * 10) + F.when(F.col("chars") < 100, 0.2).otherwise(0.0) + F.when(F.col("rows") < 5, 0.2).otherwise(0.0)
    base = F.when(F.col("rows") == 0, F.lit(0.1)).otherwise(F.lit(0.9) - lost)
    return d.select("workbook", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)), 6).alias("confidence"))


def row_listing(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """order and text of each row of a wide table: `- **Row n**` and one line for each value that is not empty."""
    entry = [F.when(value_of(c) != "", F.concat(F.lit(f"  - **{c}**: "), value_of(c))) for c in columns]
    return df.select(F.col(order), F.concat_ws("\n", F.concat(F.lit("- **Row "), F.col(order).cast("string"), F.lit("**")), *entry).alias("text"))


def pipe_rows(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """order and line: the header line (0), its rule (1), and each row of a wide table as a pipe row."""
    spark = df.sparkSession
    head = spark.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], f"{order} long, line string")
    body = df.select((F.col(order) + 1).cast("long").alias(order), F.concat(F.lit("| "), F.concat_ws(" | ", *[value_of(c) for c in columns]), F.lit(" |")).alias("line"))
    return head.unionByName(body)


def clean_column_name(name: Column) -> Column:
    """_ as space, Unnamed as Value, short upper-case words kept, others capitalised."""
    word = lambda w: F.when((w == F.upper(w)) & (F.length(w) <= 4), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))
    return F.array_join(F.transform(F.filter(F.split(F.regexp_replace(F.translate(name, "_", " "), "Unnamed", "Value"), " +"), lambda w: w != ""), word), " ")


def preview(cells: DataFrame, sheet: str, most: int = 10) -> DataFrame:
    """The cells of a sheet's first rows; an unknown sheet has none."""
    return cells.where((F.col("sheet") == sheet) & (F.col("row") <= most))


def table_profile(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """A row for each column of a wide table: idx, name, type, filled, total, its first five values in `order`, and its part: the
    first column is a category if over 30 % filled, the second of more than two a subcategory."""
    cells = F.array(*[F.struct(F.lit(i).cast("long").alias("idx"), F.lit(c).alias("name"), value_of(c).alias("v")) for i, c in enumerate(columns)])
    own = df.select(F.col(order).alias("pos"), F.explode(cells).alias("x")).select("pos", "x.*")
    totals = own.groupBy("idx", "name").agg(F.sum((F.col("v") != "").cast("long")).alias("filled"), F.count("*").alias("total"), F.min(F.when(F.col("v") != "", is_numeric(F.col("v")))).alias("num"))
    # the window keeps five rows of each column: Spark drops the rest before the shuffle
    first = own.where("v <> ''").withColumn("n", F.row_number().over(Window.partitionBy("idx").orderBy("pos"))).where("n <= 5")
    samples = first.groupBy("idx").agg(joined(F.struct("pos", F.col("v").alias("value")), ", ").alias("samples"))
    part = ladder(((F.col("idx") == 0) & (F.col("filled") * 10 > F.col("total") * 3), "category"), ((F.col("idx") == 1) & F.lit(len(columns) > 2), "subcategory"), otherwise="data")
    d = totals.join(samples, "idx", "left")
    return d.select("idx", "name", ladder((F.col("filled") == 0, "empty"), (F.col("num"), "numeric"), otherwise="text").alias("type"), "filled", "total", F.coalesce("samples", F.lit("")).alias("samples"), part.alias("part"))
