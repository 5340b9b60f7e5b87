"""Content profiles, formatting strategies, chunk plans, assembly and confidences of pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import INDENT, PAGE_BREAK, S, W, count_of, flag, has, joined, ladder, line_count, lines, listed, text_of, word_count
from .ranges import RANGE_ROWS, range_of, text_blocks
from .routing import ALIGNED, CHECKBOXES, TABLE_CHARS

#: Patterns of the content profile.
GAPS = rf"{S}{{4,}}"
PROFILE_CHECKBOXES = (r"(?i)\[[ x✓]\]", "[☐☑✓✔]", rf"(?im)^{INDENT}[x✓✔]{S}+\([a-z]\)", rf"(?im)^{INDENT}¨{S}+\([a-z]\)", rf"(?im)^{INDENT}[x✓✔]{S}+\([a-z][a-z]?\)")
BULLETS = rf"(?m)^{INDENT}[-•*]{S}"
NUMBERED = rf"(?m)^{INDENT}\p{{Nd}}+\.{S}"
TECHNICAL = (r"\$[^$]+\$", r"[A-Z][a-z]*\p{Nd}+", rf"def{S}+{W}+\(", rf"class{S}+{W}+", rf"import{S}+{W}+")
HEADERS = "(?m)^[A-Z][^.!?]*$"
FAST_CHARS = "[|─┌┐└┘]"
FAST_CHECKS = r"\[[ x✓✔]\]|☐|☑|✓|✔"
DOCUMENT_CHARS = "[|─┌┐]"
FLATTENED = rf"\*\*[^*]+\*\*{S}*-{S}*\*\*[^*]+\*\*:"
RAW_MARKS = r"\[x\]|\[X\]|☑|☐|✓|✔"
CHUNK_PAGES, LONG_PAGES, LONG_CHARS = 3, 5, 50_000


def _any(text: Column, patterns) -> Column:
    out: Column = F.lit(False)
    for p in patterns:
        out = out | has(text, p)
    return out


def content_profile(df: DataFrame, text: str = "text") -> DataFrame:
    """df with table, checkbox, list and technical flags, complexity, sections, lines and words. Patterns that may span lines run
    over the whole text. A null text counts as empty."""
    t = text_of(text)
    df = df.withColumn("has_tables", t.rlike(TABLE_CHARS) | (count_of(t, GAPS) > 5)).withColumn("has_checkboxes", _any(t, PROFILE_CHECKBOXES))
    df = df.withColumn("has_lists", has(t, BULLETS) | has(t, NUMBERED)).withColumn("has_technical", _any(t, TECHNICAL)).withColumn("_headers", count_of(t, HEADERS))
    df = df.withColumn("complexity", ladder((F.col("_headers") > 5, "complex"), (F.col("_headers") > 2, "moderate"), otherwise="simple")).withColumn("sections", F.greatest(F.lit(1), F.col("_headers")).cast("long"))
    return df.withColumn("line_count", line_count(t)).withColumn("word_count", word_count(t)).drop("_headers")


def page_strategy(profiled: DataFrame) -> DataFrame:
    """Profiled pages with strategy and the handler that runs it: structure_focused runs as standard."""
    c = F.col
    strategy = ladder((c("has_checkboxes") & c("has_tables"), "comprehensive"), (c("has_checkboxes"), "form_focused"), (c("has_tables"), "table_focused"), (c("has_technical"), "technical"), (c("complexity") == "complex", "structure_focused"), otherwise="standard")
    df = profiled.withColumn("strategy", strategy)
    return df.withColumn("handler", F.when(c("strategy") == "structure_focused", "standard").otherwise(c("strategy")))


def document_structure(pages: DataFrame) -> DataFrame:
    """One row a document: table and form pages, elements, challenges, section structure and strategy."""
    t = text_of()
    flags = pages.select("doc_id", (t.rlike(DOCUMENT_CHARS) | (count_of(t, ALIGNED) > 3)).cast("long").alias("tb"), _any(t, CHECKBOXES).cast("long").alias("fm"), count_of(t, HEADERS).alias("hd"))
    d = flags.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.sum("tb").alias("table_pages"), F.sum("fm").alias("form_pages"), F.sum("hd").alias("headers"))
    c = F.col
    throughout, forms = c("table_pages") * 10 > c("total_pages") * 3, c("form_pages") > 0
    d = d.withColumn("elements", F.array_join(listed((throughout, "tables_throughout"), (forms, "form_elements")), ",")).withColumn("challenges", F.array_join(listed((throughout, "consistent_table_formatting"), (forms, "checkbox_standardization")), ","))
    d = d.withColumn("structure", ladder((c("headers") > 2 * c("total_pages"), "complex"), (c("headers") > c("total_pages"), "moderate"), otherwise="simple"))
    tables = c("table_pages") > 0
    return d.withColumn("strategy", ladder((tables & forms, "comprehensive_document"), (tables & throughout, "table_heavy_document"), (forms, "form_document"), (c("structure") == "complex", "structured_document"), otherwise="standard_document"))


def assemble(pages: DataFrame, separator: str = PAGE_BREAK, text: str = "text", order: str = "page_no") -> DataFrame:
    """One text a document, its pages in order."""
    return pages.groupBy("doc_id").agg(joined(F.struct(F.col(order).alias("pos"), text_of(text).alias("value")), separator).alias("text"), F.count("*").alias("pages"))


def assemble_blocks(pages: DataFrame, separator: str = PAGE_BREAK, text: str = "text", order: str = "page_no", budget: int = 1 << 20, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, block, start and text: the texts of `assemble` as ordered blocks of at most `budget` bytes, however long a document is.
    Pages are ranged by their number; null texts count as empty."""
    d = pages.select("doc_id", F.col(order).alias("at"), text_of(text).alias("text"))
    return text_blocks(d, ["doc_id"], range_of("at", range_rows), ["at"], "text", separator, budget)


def simple_documents(pages: DataFrame) -> DataFrame:
    """One row a document with is_simple (long plain prose), and for these the text, ready at confidence 0.9."""
    d = assemble(pages, "\n\n")
    t, n = F.col("text"), F.col("pages")
    plain = (n > 3) & ~t.rlike(FAST_CHARS) & ~t.rlike(FAST_CHECKS) & (count_of(t, ALIGNED) <= n * 3) & (count_of(t, HEADERS) <= n * 2) & (count_of(t, BULLETS) + count_of(t, NUMBERED) <= n * 3)
    return d.withColumn("is_simple", plain).withColumn("confidence", F.when(plain, 0.9)).withColumn("text", F.when(plain, t))


def chunk_plan(pages: DataFrame) -> DataFrame:
    """doc_id, chunk_no (from 0), first_page, last_page and text: chunks of three pages for long documents, else one chunk."""
    doc = Window.partitionBy("doc_id")
    marked = pages.withColumn("_n", F.row_number().over(doc.orderBy("page_no")) - 1).withColumn("_pages", F.count("*").over(doc)).withColumn("_chars", F.sum(F.length(text_of())).over(doc))
    long = (F.col("_pages") > LONG_PAGES) | (F.col("_chars") > LONG_CHARS)
    chunked = marked.withColumn("chunk_no", F.when(long, F.floor(F.col("_n") / CHUNK_PAGES)).otherwise(0).cast("long"))
    return chunked.groupBy("doc_id", "chunk_no").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), joined(F.struct(F.col("page_no").alias("pos"), text_of().alias("value")), PAGE_BREAK).alias("text"))


def request_table(chunks: DataFrame, most: int = 50_000) -> DataFrame:
    """One request a chunk: system and user message, the text cut to `most` characters, and whether it was cut."""
    head = F.concat(F.lit("Format pages "), F.col("first_page").cast("string"), F.lit("-"), F.col("last_page").cast("string"), F.lit(" as Markdown:\n\n"))
    return chunks.select("doc_id", "chunk_no", F.lit("You format documents for retrieval.").alias("system"), F.concat(head, F.substring("text", 1, most)).alias("user"), (F.length("text") > most).alias("truncated"))


def merge_responses(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    """One text a document: each chunk's successful response, else its original text, in order; tokens and fallbacks counted."""
    ok = responses.where("success").select("doc_id", "chunk_no", "content", "tokens")
    both = chunks.join(ok, ["doc_id", "chunk_no"], "left").withColumn("value", F.coalesce("content", "text"))
    return both.groupBy("doc_id").agg(joined(F.struct(F.col("chunk_no").alias("pos"), "value"), "\n\n").alias("text"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.sum(F.col("content").isNull().cast("long")).alias("fallbacks"))


def _clamped(*hundredths: tuple[Column, int], base: int) -> Column:
    """base plus the points whose rules hold, in hundredths, clamped to 0..1."""
    total: Column = F.lit(base)
    for rule, n in hundredths:
        total = total + F.when(flag(rule), n).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), total)) / 100


def page_confidence(df: DataFrame) -> DataFrame:
    """Profiled originals (text) with `formatted`, and format_confidence."""
    a, b = text_of(), text_of("formatted")
    n, m = F.length(a), F.length(b)
    some, c = n > 0, F.col
    return df.withColumn("format_confidence", _clamped((some & (m * 2 < n), -30), (some & (m > n * 2), -20), (~some | ((m * 10 >= n * 8) & (m * 10 <= n * 12)), 5), ((c("sections") > 1) & has(b, rf"(?m)^#{{2,3}}{S}"), 5), (c("has_tables") & b.contains("**"), 5), (c("has_checkboxes") & b.contains("[SELECTED]"), 5), (F.size(lines(b)) * 2 > F.size(lines(a)), 5), base=85))


def document_confidence(df: DataFrame) -> DataFrame:
    """Documents (text, formatted, has_tables, has_forms) with doc_confidence."""
    a, b, c = text_of(), text_of("formatted"), F.col
    n, m, flat = F.length(a), F.length(b), has(b, FLATTENED)
    near, lost = (n > 0) & (m * 10 >= n * 7) & (m * 10 <= n * 13), (n > 0) & (m * 2 < n)
    return df.withColumn("doc_confidence", _clamped((has(b, r"(?m)^## ") & has(b, r"(?m)^### "), 5), (c("has_tables") & flat, 10), (c("has_tables") & ~flat, -20), (c("has_forms") & b.rlike(r"\[SELECTED\]|\[ \]"), 5), (near, 5), (lost, -20), base=80))


def consistency_score(df: DataFrame, text: str = "formatted") -> DataFrame:
    """df with consistency: the share of three checks (headers, table entries, check marks) that hold."""
    t = text_of(text)
    headers = F.forall(F.filter(lines(t), lambda x: x.startswith("#")), lambda x: x.rlike("^#{2,4} "))
    tables = ~t.contains("**") | t.rlike(FLATTENED)
    marks = ~t.rlike(r"\[SELECTED\]|\[ \]") | ~t.rlike(RAW_MARKS)
    return df.withColumn("consistency", (headers.cast("int") + tables.cast("int") + marks.cast("int")) / 3)


def extraction_confidence(df: DataFrame) -> DataFrame:
    """Extractions (text, width, height, retries, strategy) with ocr_confidence and the plainer base_confidence."""
    t, pixels, c = text_of(), F.col("width") * F.col("height"), F.col
    n, retries = F.length(t), F.greatest(F.coalesce("retries", F.lit(0)), F.lit(0))
    table = (c("strategy") == "table_focused") & F.lower(t).contains("table")
    form = (c("strategy") == "form_focused") & t.rlike(r"[\[☑☐]")
    total = sum((F.when(flag(r), v).otherwise(0) for r, v in ((n < 10, -40), (n > 1000, 5), (pixels < 100_000, -20), (pixels > 1_000_000, 10), (table, 5), (form, 5))), F.lit(85)) - retries * 15
    base = sum((F.when(flag(r), v).otherwise(0) for r, v in ((n < 10, -30), (n > 1000, 10))), F.lit(80)) - retries * 10
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(100), x)) / 100
    return df.withColumn("ocr_confidence", clamp(total)).withColumn("base_confidence", clamp(base))


def table_format(df: DataFrame, text: str = "formatted") -> DataFrame:
    """df with table_format: flattened or pipe by over ten such entries, else none; null counts as empty."""
    t = text_of(text)
    return df.withColumn("table_format", ladder((count_of(t, FLATTENED) > 10, "flattened"), (count_of(t, r"\|[^|]+\|") > 10, "pipe"), otherwise="none"))
