"""Pages, page selections, filters and small projections over documents, files and settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import S, ladder, strip, text_of, title_case

DOCUMENT_KINDS = ("pdf", "md", "markdown", "txt", "xlsx", "xls", "csv")
SHEET_KINDS = ("xlsx", "xls", "csv")
FIELDS = ("filename", "page", "confidence", "progress", "header_rows", "role", "recommendation")
ROLES = ("label_1", "label_2", "label_3", "label_4", "label_5", "data", "ignore")
#: Status colours.
COLORS = {"ACCEPT": "#17702E", "REJECT": "#FF453A", "REVIEW": "#BE8200"}
DEFAULT_COLOR = "#737373"


def page_selection(pages: DataFrame, specs: DataFrame, mode: str = "strict") -> DataFrame:
    """doc_id, page_no and spec_error of the pages that each document's spec ("1-5, 10") selects.

    A blank spec selects all pages. strict: one bad range makes the whole spec invalid, reported as a row without a page; clip:
    keeps what lies within the document and skips bad parts. Results are distinct. Null specs count as blank; documents without
    a spec row select nothing.
    """
    totals = pages.groupBy("doc_id").agg(F.max("page_no").alias("total"))
    known = specs.join(totals, "doc_id").withColumn("spec", strip(text_of("spec"))).withColumn("all", F.lower("spec").isin("", "all"))
    parts = known.where("not all").select("doc_id", "total", "spec", F.posexplode(F.split("spec", ",")).alias("part_no", "part")).withColumn("part", strip(F.col("part")))
    number = rf"^{S}*[+-]?[0-9]{{1,9}}{S}*\z"
    ranged = F.col("part").contains("-")
    ends = F.split("part", "-", 2)
    first, last = F.when(ranged, ends[0]).otherwise(F.col("part")), F.when(ranged, ends[1]).otherwise(F.col("part"))
    parts = parts.withColumn("a", F.when(first.rlike(number), strip(first).try_cast("int"))).withColumn("b", F.when(last.rlike(number), strip(last).try_cast("int")))
    bad = F.col("a").isNull() | F.col("b").isNull()
    outside = (F.col("a") < 1) | (F.col("b") > F.col("total")) | (F.col("a") > F.col("b"))
    total = F.col("total").cast("string")
    in_range = F.concat(F.lit("Invalid range "), F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string"), F.lit(". Pages must be between 1 and "), total)
    alone = F.concat(F.lit("Page "), F.col("a").cast("string"), F.lit(" is out of range. Document has "), total, F.lit(" pages"))
    parts = parts.withColumn("error", ladder((bad, F.concat(F.lit("Invalid page range format: "), "spec")), (outside & ranged, in_range), (outside, alone)))
    whole = known.where("all").select("doc_id", F.lit(1).alias("a"), F.col("total").cast("int").alias("b"))
    if mode == "strict":
        errors = parts.where("error is not null").groupBy("doc_id").agg(F.min_by("error", "part_no").alias("spec_error"))
        spans = parts.join(errors.select("doc_id"), "doc_id", "left_anti").select("doc_id", "a", "b")
    else:
        errors = None
        spans = parts.where(~bad).select("doc_id", F.greatest("a", F.lit(1)).alias("a"), F.least("b", F.col("total").cast("int")).alias("b")).where("a <= b")
    picked = spans.unionByName(whole).select("doc_id", F.explode(F.sequence(F.col("a").cast("long"), F.col("b").cast("long"))).alias("page_no")).distinct()
    out = pages.select("doc_id", "page_no").join(picked, ["doc_id", "page_no"], "left_semi").withColumn("spec_error", F.lit(None).cast("string"))
    return out if errors is None else out.unionByName(errors.select("doc_id", F.lit(None).cast("long").alias("page_no"), "spec_error"))


def reject_reason(df: DataFrame, text: str = "text") -> DataFrame:
    """df with reject_reason: blank, unextracted or mostly urls; null for usable texts."""
    t = strip(text_of(text))
    urls = F.length(F.array_join(F.regexp_extract_all(t, F.lit(r"https?://[^\s\x{85}\p{Z}]+"), F.lit(0)), ""))
    return df.withColumn("reject_reason", ladder((t == "", "blank"), (t.startswith("[Page") & t.contains("No text could be extracted"), "no_text"), ((F.length(t) < 200) & (urls * 10 > F.length(t) * 7), "mostly_urls")))


def file_facts(files: DataFrame) -> DataFrame:
    """files (path) with suffix, kind, supported and title: the stem with - and _ as spaces in title case, else Document."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    title = title_case(strip(F.translate(stem, "-_", "  ")))
    kind = ladder((suffix.isin(*SHEET_KINDS), "sheet"), (suffix.isin("md", "markdown", "txt"), "text"), (suffix == "pdf", "paged"), otherwise="unsupported")
    return files.withColumn("suffix", suffix).withColumn("kind", kind).withColumn("supported", suffix.isin(*DOCUMENT_KINDS)).withColumn("title", F.when(title == "", "Document").otherwise(title))


def text_source(files: DataFrame) -> DataFrame:
    """path, content of text files: .txt gets a title line, Markdown passes through."""
    known = file_facts(files).where("kind = 'text'")
    return known.select("path", F.when(F.col("suffix") == "txt", F.concat(F.lit("# "), "title", F.lit("\n\n"), text_of())).otherwise(text_of()).alias("content"))


def violations(records: DataFrame) -> DataFrame:
    """records (filename, page, confidence, progress, header_rows, role, recommendation) with the rules that each breaks.

    A null field breaks its rule.
    """
    holds = {
        "filename": F.length("filename").between(1, 255),
        "page": F.col("page") >= 1,
        "confidence": F.col("confidence").between(0, 1),
        "progress": F.col("progress").between(0, 100),
        "header_rows": F.col("header_rows").between(0, 10),
        "role": F.col("role").isin(*ROLES),
        "recommendation": F.col("recommendation").rlike(r"^(YES|NO)\z"),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in holds.items()]))
    return records.withColumn("violations", F.array_join(broken, ",")).withColumn("valid", F.size(broken) == 0)


def error_records(checked: DataFrame, at: str) -> DataFrame:
    """The quarantine of `violations`: rows that break a rule, with error (type), message, details (a map from field to its value as
    text, null where it is null) and the time `at`, which is given, never read from a clock. Valid rows give none."""
    fields = F.filter(F.split("violations", ","), lambda f: f != "")
    values = F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f).cast("string"))])
    message = F.concat(F.lit("Invalid "), F.array_join(fields, ", "))
    return checked.where("not valid").withColumn("error", F.lit("ValidationError")).withColumn("message", message).withColumn("details", F.map_filter(values, lambda k, v: F.array_contains(fields, k))).withColumn("timestamp", F.lit(at).cast("timestamp"))


def clean_settings(settings: DataFrame) -> DataFrame:
    """doc_id, page_no, setting of usable rows: an integer page and YES or NO in any case."""
    return settings.select("doc_id", F.expr("try_cast(page_no AS bigint)").alias("page_no"), F.upper(strip(text_of("setting"))).alias("setting")).where("page_no is not null and setting in ('YES', 'NO')")


def with_task_config(tasks: DataFrame, config: DataFrame) -> DataFrame:
    """tasks (task) with model, provider, temperature and max_tokens of their own row of config, else of `main`."""
    fields = [c for c in config.columns if c != "task"]
    main = config.where("task = 'main'").select(*[F.col(c).alias(f"main_{c}") for c in fields], F.lit(1).alias("_one"))
    # config is a dimension of a handful of rows, one for each kind of task
    out = tasks.join(F.broadcast(config), "task", "left").withColumn("_one", F.lit(1)).join(F.broadcast(main), "_one", "left")
    return out.select(*tasks.columns, *[F.coalesce(c, f"main_{c}").alias(c) for c in fields])


def column_roles(columns: DataFrame) -> DataFrame:
    """columns (sheet, idx, header, role) with normal roles; `ignore` is dropped. A null role gets the default: the first three
    columns are Label 1 to 3, others Data."""
    default = F.when(F.col("idx") < 3, F.concat(F.lit("Label "), (F.col("idx") + 1).cast("string"))).otherwise("Data")
    role = F.replace(F.lower(F.coalesce("role", default)), F.lit(" "), F.lit("_"))
    out = columns.withColumn("role", role).where("role <> 'ignore'")
    return out.withColumn("type", F.when(F.col("role").startswith("label"), "text").otherwise("data"))


def clean_table(df: DataFrame) -> DataFrame:
    """All values as trimmed strings, nulls as '', column names trimmed, rows without any value dropped."""
    cols = [strip(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c.strip()) for c in df.columns]
    out = df.select(*cols)
    return out.where(reduce(Column.__or__, [F.col(f"`{c.strip()}`") != "" for c in df.columns]))


def score_display(score: Column, most: int = 100) -> Column:
    """A score to one decimal with its maximum; null and unreadable ones are N/A."""
    return F.coalesce(F.concat(F.format_number(score.try_cast("double"), 1), F.lit(f"/{most}")), F.lit("N/A"))


def short_number(n: Column) -> Column:
    """1.2M, 25.3K or the number; null stays null."""
    plain = lambda x: F.translate(F.format_number(x, 1), ",", "")
    return ladder((n >= 1_000_000, F.concat(plain(n / 1_000_000), F.lit("M"))), (n >= 1000, F.concat(plain(n / 1000), F.lit("K"))), otherwise=n.cast("string"))


def color_of(recommendation: Column) -> Column:
    """The colour of a recommendation in any case; null and others get the default."""
    return ladder(*[(F.upper(recommendation) == k, v) for k, v in COLORS.items()], otherwise=DEFAULT_COLOR)


def text_recommendations(files: DataFrame) -> DataFrame:
    """Text files need no page analysis: one row each, page 1, NO, at full confidence."""
    return file_facts(files).where("kind = 'text'").select("path", F.lit(1).cast("long").alias("page_no"), F.lit("NO").alias("recommendation"), F.lit(1.0).alias("confidence"), F.lit("Text-only file").alias("reason"))
