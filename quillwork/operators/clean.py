"""Text cleaning: commentary, placeholders, pipe tables, check marks and footnotes, with reports on what was removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANK, S, chars_among, joined, lines, once, strip, text_of, unix

#: Commentary labels and patterns in the order of removal, and placeholders.
COMMENTARY = [
    ("Unable statement", r"(?im)I'm unable to.*?(?:\.|$)"),
    ("Cannot statement", r"(?im)I cannot.*?(?:\.|$)"),
    ("Help offer", r"(?im)If you have any.*?(?:\.|$)"),
    ("Help offer", r"(?im)feel free to ask.*?(?:\.|$)"),
    ("Apology", r"(?im)I apologize.*?(?:\.|$)"),
    ("Please note", r"(?im)Please note.*?(?:\.|$)"),
    ("It appears", r"(?im)It appears.*?(?:\.|$)"),
    ("Based on", r"(?im)Based on.*?(?:\.|$)"),
    ("Cell content note", r"(?im)\[.*?including wrapped cell content.*?\]"),
    ("Here is", r"(?im)Here is.*?(?:\.|$)"),
    ("The following", r"(?im)The following.*?(?:\.|$)"),
]
EXTRACTION_COMMENTARY = [(k, p) for k, p in COMMENTARY if k != "Cell content note"] + [("As requested", r"(?im)As requested.*?(?:\.|$)"), ("I'll extract", r"(?im)I'll extract.*?(?:\.|$)")]
NOTE = "including wrapped cell content"
PLACEHOLDER = r"(?i)\[(To be completed|Not specified|Missing|N/A|TBD|Unknown|Pending|None|To fill|Fill in)\]"
EMPTY_SHAPES = (rf"^[{BLANK}*#-]*\*\*[^*]+\*\*{S}*(?::{S}*)?\[.+?\]{S}*$", rf"^[{BLANK}*#-]*\[.+?\]{S}*$")
PIPE_ROW = rf"^\||[^\s\x{{85}}\p{{Z}}]{S}*\|{S}*[^\s\x{{85}}\p{{Z}}]"
RULE_CELL = rf"^{S}*:?--+{S}*$"
SEPARATOR_CELL = rf"^{S}*[-:]+{S}*$"
SUPERSCRIPTS, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"
CITATIONS = (rf"[{SUPERSCRIPTS}]+", r"\[\p{Nd}+\]", r"\(\p{Nd}+\)", r"(?<!\p{Nd})\p{Nd}++(?=\s|$|[.,;:])")
FOOTNOTE_LINE = rf"^([{SUPERSCRIPTS}]+|\p{{Nd}}+)\.?{S}+(.+)$"


def _tidy(text: Column) -> Column:
    once = F.regexp_replace(text, rf"\n{S}*\n{S}*\n", "\n\n")
    return strip(F.regexp_replace(once, rf"^{S}*\n", ""))


def clean_commentary(df: DataFrame, text: str = "text", patterns=COMMENTARY) -> DataFrame:
    """df with cleaned (the text without commentary) and removed ("Label: 'text'" of each find).

    Finds are taken from the original text, removals run on the progressively cleaned one. A null text counts as empty.
    """
    t = text_of(text)
    # a pattern runs only where its phrase is
    holds = lambda x, pattern: F.lower(x).contains(NOTE if NOTE in pattern else pattern.removeprefix("(?im)").split(".*?")[0].lower())

    def finds(label: str, pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(unix(pattern)), F.lit(0)), lambda m: F.concat(F.lit(f"{label}: '"), strip(m), F.lit("'")))
        return F.when(holds(t, pattern), found).otherwise(F.array().cast("array<string>"))

    found = F.flatten(F.array(*[finds(k, p) for k, p in patterns]))
    df = df.withColumn("removed", found).withColumn("cleaned", t)
    c = F.col("cleaned")
    for _, p in patterns:
        df = df.withColumn("cleaned", F.when(holds(c, p), F.regexp_replace(c, unix(p), "")).otherwise(c))
    return df.withColumn("cleaned", _tidy(c))


def strip_placeholders(df: DataFrame, text: str = "text") -> DataFrame:
    """df with stripped (without lines that hold only a placeholder, bare or labelled) and n_dropped."""
    own = lines(text_of(text))

    def empty(line: Column) -> Column:
        x = strip(line)
        return x.rlike(PLACEHOLDER) & (x.rlike(EMPTY_SHAPES[0]) | x.rlike(EMPTY_SHAPES[1]))

    df = df.withColumn("_kept", F.filter(own, lambda x: ~empty(x))).withColumn("n_dropped", (F.size(own) - F.size("_kept")).cast("long"))
    return df.withColumn("stripped", strip(F.regexp_replace(F.array_join("_kept", "\n"), rf"\n{S}*\n{S}*\n+", "\n\n"))).drop("_kept")


def is_table_row(line: Column) -> Column:
    x = strip(line)
    return ~x.startswith("```") & (chars_among(x, "|") >= 2) & (x.rlike(PIPE_ROW) | _all_cells(x, RULE_CELL, 2))


def _all_cells(row: Column, pattern: str, least: int = 1) -> Column:
    """Whether a row has so many cells and each is as in the pattern; a bar at either edge stands for no cell."""
    cells = F.split(F.regexp_replace(row, r"^\||\|$", ""), r"\|")
    return (F.size(cells) >= least) & F.forall(cells, lambda c: c.rlike(pattern))


def _with_blocks(docs: DataFrame) -> DataFrame:
    """docs with _lines and _blocks: (start, end, rows) of each run of pipe rows, in order. All inside the row."""

    def blocks(p: Column) -> Column:
        own, row = p["lines"], p["row"]
        spots = F.sequence(F.lit(0), F.size(own) - 1)
        beside = lambda i, step: F.coalesce(F.get(row, i + step), F.lit(False))
        starts = F.filter(spots, lambda i: F.get(row, i) & ~beside(i, -1))
        ends = F.filter(spots, lambda i: F.get(row, i) & ~beside(i, 1))
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end"), F.slice(own, s + 1, e - s + 1).alias("rows")))

    # whether a line is a row is told once a line, not again for each of its neighbours' lines
    marked = lambda own: once(F.struct(own.alias("lines"), F.transform(own, is_table_row).alias("row")), blocks)
    return docs.withColumn("_lines", lines(text_of())).withColumn("_blocks", once(lines(text_of()), marked))


def table_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, first_line, last_line and size of each run of pipe rows, lines counted from 0. Each row of docs is taken by itself,
    whatever doc_id it repeats; null and empty texts have none."""
    own = _with_blocks(docs.where(text_of().contains("|")).select("doc_id", "text"))
    b = own.select("doc_id", F.explode("_blocks").alias("b"))
    return b.select("doc_id", F.col("b.start").cast("long").alias("first_line"), F.col("b.end").cast("long").alias("last_line"), (F.col("b.end") - F.col("b.start") + 1).cast("long").alias("size"))


def _cells(line: Column) -> Column:
    """Trimmed cells of a pipe row without empty edge cells."""
    parts = F.transform(F.split(strip(line), r"\|"), strip)
    parts = F.when(F.get(parts, F.lit(0)) == "", F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    return F.when((F.size(parts) > 0) & (F.get(parts, F.size(parts) - 1) == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def _plain(cell: Column) -> Column:
    return F.regexp_replace(cell, r"\*\*(.*?)\*\*", "$1")


def flatten_tables(docs: DataFrame, align: str = "shift") -> DataFrame:
    """doc_id and text with every pipe table of two or more lines as `**Header** - **Row**: Value` lines.

    A table's first line names its columns, an optional rule follows, and a row's first cell names the row. With align `shift` empty
    names and an empty first cell fall away, which moves what follows to the left; with `position` every cell keeps its column, and a
    column without a name gives values without one. Tables that give no entry keep their lines. Each row of docs is taken by itself, without a shuffle, whatever doc_id it
    repeats; null texts count as empty, and texts without a pipe pass through without being taken apart.
    """

    if align not in ("shift", "position"):
        raise ValueError(f"unknown alignment: {align}")
    shift = align == "shift"

    def parsed(b: Column) -> Column:
        names = _cells(F.get(b["rows"], F.lit(0)))
        headers = F.transform(F.filter(names, lambda c: c != "") if shift else names, _plain)
        named = lambda cells: F.when(F.get(cells, F.lit(0)) == "", F.slice(cells, F.lit(2), F.size(cells))).otherwise(cells)
        second, cells = F.get(b["rows"], F.lit(1)), F.transform(b["rows"], _cells)
        return F.struct(b.alias("b"), headers.alias("headers"), (F.transform(cells, named) if shift else cells).alias("cells"), F.coalesce(_all_cells(strip(second), SEPARATOR_CELL), F.lit(False)).alias("ruled"))

    def entries(p: Column) -> Column:
        def of_row(cells: Column, n: Column) -> Column:
            row_id = F.get(cells, F.lit(0))

            def entry(value: Column, j: Column) -> Column:
                name = F.get(p["headers"], j)
                label = F.when(name != "", F.concat(F.lit("**"), name, F.lit("**")))
                row = F.when(row_id != "", F.concat(F.lit("**"), _plain(row_id), F.lit("**")))
                named = F.concat_ws(": ", F.nullif(F.concat_ws(" - ", label, row), F.lit("")), _plain(value))
                return F.when((j > 0) & (j < F.size(p["headers"])) & (value != ""), named)

            data = (n > 1) | ((n == 1) & ~p["ruled"])
            return F.when(data, F.array_compact(F.transform(cells, entry))).otherwise(F.array().cast("array<string>"))

        return F.struct(p["b"].alias("b"), F.flatten(F.transform(p["cells"], of_row)).alias("entries"))

    df = _with_blocks(docs.where(text_of().contains("|")).select("doc_id", "text")).withColumn("_tables", F.transform(F.transform("_blocks", parsed), entries))
    end = lambda k: F.coalesce(F.get("_tables", k)["b"]["end"], F.lit(-1))
    given = lambda t: F.when((F.size(t["b"]["rows"]) >= 2) & (F.size(t["entries"]) > 0), t["entries"]).otherwise(t["b"]["rows"])
    # the lines since the last table, then the table
    piece = lambda t, k: F.concat(F.slice("_lines", end(k - 1) + 2, t["b"]["start"] - end(k - 1) - 1), given(t))
    last = end(F.size("_tables") - 1)
    rest = F.slice("_lines", last + 2, F.size("_lines") - last - 1)
    flat = df.select("doc_id", F.array_join(F.concat(F.flatten(F.transform("_tables", piece)), rest), "\n").alias("text"))
    return flat.unionByName(docs.where(~text_of().contains("|")).select("doc_id", text_of().alias("text")))


def normalise_checkboxes(df: DataFrame, text: str = "text") -> DataFrame:
    """df with marked: checked marks before a label become `*[SELECTED]*` after it, unchecked marks are dropped."""
    t = text_of(text)
    # blanks before a mark, on its own line; a label ends at its line's last character that is not blank
    lead = r"([\t\f\r\x0B\x{85}\p{Z}]*)"
    checked = F.regexp_replace(t, rf"(?md)^{lead}(?:\[[xX✓✔]\]|[☑✓✔]){S}*((?:.*[^{BLANK}])?){S}*$", "$1$2 *[SELECTED]*")
    return df.withColumn("marked", F.regexp_replace(checked, rf"(?md)^{lead}(?:\[ \]|☐){S}*", "$1"))


def cleaning_report(cleaned: DataFrame) -> DataFrame:
    """One row a document of cleaned pages (doc_id, page_no, removed): pages, pages with removals, fragments, rate and a line
    of fragment types by count and name."""
    pages = cleaned.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum((F.size("removed") > 0).cast("long")).alias("pages_cleaned"), F.sum(F.size("removed")).alias("fragments"))
    types = cleaned.select("doc_id", F.explode("removed").alias("f")).groupBy("doc_id", F.substring_index("f", ":", 1).alias("type")).count()
    told = types.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "type"))), lambda x: F.concat(x["type"], F.lit("="), (-x["n"]).cast("string"))), ", ").alias("types"))
    return pages.join(told, "doc_id", "left").withColumn("rate", F.col("pages_cleaned") * 100 / F.col("pages")).withColumn("types", F.coalesce("types", F.lit("")))


def cleaning_report_text(cleaned: DataFrame) -> DataFrame:
    """doc_id, report and summary of cleaned pages: counts, types by count and name, and the fragments page by page, pages
    ascending; the summary is one line. Documents without removals say so."""
    s = lambda n: F.when(n == 1, "").otherwise("s")
    n = F.size("removed")
    page = F.concat(F.lit("### Page "), F.col("page_no").cast("string"), F.lit(" ("), n.cast("string"), F.lit(" fragment"), s(n), F.lit(")\n"), F.array_join(F.transform("removed", lambda x: F.concat(F.lit("- "), x)), "\n"))
    told = cleaned.where(n > 0).groupBy("doc_id").agg(joined(F.struct(F.col("page_no").alias("pos"), page.alias("value")), "\n\n").alias("by_page"))
    d = cleaning_report(cleaned).join(told, "doc_id", "left")
    rate, count = F.format_number("rate", 1), lambda c: F.col(c).cast("string")
    head = F.concat(F.lit("# Cleaning report\n\n- Pages: "), count("pages"), F.lit("\n- Cleaned pages: "), count("pages_cleaned"), F.lit("\n- Fragments: "), count("fragments"), F.lit("\n- Rate: "), rate, F.lit("%\n\n"))
    types = F.array_join(F.transform(F.split("types", ", "), lambda x: F.concat(F.lit("- "), F.replace(x, F.lit("="), F.lit(": ")))), "\n")
    body = F.when(F.col("fragments") > 0, F.concat(F.lit("## Types\n\n"), types, F.lit("\n\n## Pages\n\n"), F.col("by_page"))).otherwise("Nothing was removed.")
    line = F.when(F.col("fragments") > 0, F.concat(F.lit("Removed "), count("fragments"), F.lit(" fragment"), s(F.col("fragments")), F.lit(" from "), count("pages_cleaned"), F.lit("/"), count("pages"), F.lit(" pages ("), rate, F.lit("%)"))).otherwise("Nothing was removed")
    return d.select("doc_id", F.concat(head, body).alias("report"), line.alias("summary"))


def top_fragment_types(cleaned: DataFrame, most: int = 3) -> DataFrame:
    """The most frequent fragment types over all pages, ties by name, with their rank."""
    counts = cleaned.select(F.explode("removed").alias("f")).groupBy(F.substring_index("f", ":", 1).alias("type")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "type").limit(most).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "type")).cast("long"))


def ascii_marker(marker: Column) -> Column:
    return F.translate(F.regexp_replace(marker, r"[\[\]()]", ""), SUPERSCRIPTS, DIGITS)


def with_footnotes(df: DataFrame, text: str = "text") -> DataFrame:
    """df with notes: (full, key, note) of each citation whose footnote line exists, each marker once, in text order."""
    own = F.transform(lines(text_of(text)), strip)
    own_line = lambda x: x.rlike(rf"^(?:[{SUPERSCRIPTS}]+|\[\p{{Nd}}+\]|\(\p{{Nd}}+\)|\p{{Nd}}+(?=\s|$|[.,;:]))")
    body = F.filter(own, lambda x: ~own_line(x))
    df = df.withColumn("_note_lines", F.filter(own, lambda x: x.rlike(FOOTNOTE_LINE))).withColumn("_body", body)
    cites = F.array_distinct(F.flatten(F.transform("_body", lambda x: F.concat(*[F.regexp_extract_all(x, F.lit(p), F.lit(0)) for p in CITATIONS]))))
    key = lambda x: ascii_marker(F.regexp_extract(x, FOOTNOTE_LINE, 1))

    def note(full: Column) -> Column:
        line = F.get(F.filter("_note_lines", lambda x: key(x) == ascii_marker(full)), F.lit(0))
        return F.struct(full.alias("full"), ascii_marker(full).alias("key"), strip(F.regexp_extract(line, FOOTNOTE_LINE, 2)).alias("note"))

    df = df.withColumn("_notes", F.when(F.size("_note_lines") > 0, F.filter(F.transform(cites, note), lambda n: n["note"].isNotNull() & (n["note"] != ""))).otherwise(F.array().cast("array<struct<full:string,key:string,note:string>>")))
    first = F.filter("_notes", lambda n, i: ~F.exists(F.slice("_notes", F.lit(1), i), lambda m: m["key"] == n["key"]))
    return df.withColumn("notes", first).drop("_note_lines", "_body", "_notes")


def footnotes_inline(df: DataFrame, text: str = "text", style: str = "inline", most: int = 200, keep_marker: bool = False) -> DataFrame:
    """df with noted: footnote lines dropped and citations replaced by ` (note)`, longest marker first.

    inline cuts notes at `most` characters; minimal takes a note up to its first period and comma, at most 100; preserve keeps
    the text. Later replacements see earlier ones' results.
    """
    t = text_of(text)
    if style == "preserve":
        return df.withColumn("noted", t)
    df = with_footnotes(df, text)
    bare = lambda a, n: F.array_join(F.transform(F.split(a, "\n"), lambda x: F.when(x.rlike(FOOTNOTE_LINE) & (ascii_marker(F.regexp_extract(x, FOOTNOTE_LINE, 1)) == n["key"]), "").otherwise(x)), "\n")
    cut = (lambda n: F.when(F.length(n) > most, F.concat(F.substring(n, 1, most - 3), F.lit("..."))).otherwise(n)) if style == "inline" else (lambda n: F.substring(strip(F.substring_index(F.substring_index(n, ".", 1), ",", 1)), 1, 100))
    said = lambda n: F.concat(n["full"] if keep_marker else F.lit(""), F.lit(" ("), cut(n["note"]), F.lit(")"))
    ordered = F.array_sort("notes", lambda a, b: F.length(b["full"]) - F.length(a["full"]))
    gone = F.aggregate("notes", t, bare)
    put = F.aggregate(ordered, gone, lambda a, n: F.replace(a, n["full"], said(n)))
    return df.withColumn("noted", F.when(F.size("notes") > 0, strip(F.regexp_replace(put, rf"\n{S}*\n{S}*\n+", "\n\n"))).otherwise(t))
