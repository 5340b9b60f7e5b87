"""Page analysis and routing: flags and quality of a page's text, the method for it, quotas, overrides and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import INDENT, S, W, chars_among, count_of, flag, has, ladder, listed, points, strip, text_of, whole_words, word_count
from .quality import ODD_CHARACTER, QUOTA

#: Characters and patterns of the page analysis.
TABLE_CHARS = "[|─┌┐└┘├┤┬┴┼]"
ALIGNED = rf"{W}{S}{{4,}}{W}"
CHECKBOXES = (r"(?i)\[[ x✓✔]\]", "[☐☑✓✔]", rf"(?im)^{INDENT}[x✓✔¨]{S}*\([a-z]+\)")
STRUCTURED = rf"(?m)^{INDENT}[A-Z][^:]*:{S}*\$?\p{{Nd}}"
FIGURE = rf":{S}*\$?\p{{Nd}}"


def _any(text: Column, patterns) -> Column:
    out: Column = F.lit(False)
    for p in patterns:
        out = out | has(text, p)
    return out


def analyse_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """pages with has_tables, has_checkboxes, has_structured, text_quality, quality_score and indicators (in check order).

    Blank and null texts are `missing`, quality 0.
    """
    t = text_of(text)
    df = pages.withColumn("_blank", strip(t) == "").withColumn("_box", t.rlike(TABLE_CHARS)).withColumn("_aligned", count_of(t, ALIGNED) > 3)
    df = df.withColumn("_check", _any(t, CHECKBOXES)).withColumn("_structured", t.rlike(FIGURE) & has(t, STRUCTURED))
    df = df.withColumn("_n", word_count(t)).withColumn("_single", whole_words(t, r"\p{L}")).withColumn("_letters", F.length(F.regexp_replace(t, f"{S}+", "")))
    dense = F.length(F.translate(t, " \n", ""))
    df = df.withColumn("_fragmented", (F.col("_n") > 0) & (F.col("_single") * 10 > F.col("_n"))).withColumn("_short", (F.col("_n") > 0) & (F.col("_letters") * 2 < F.col("_n") * 5))
    df = df.withColumn("_spaced", (F.col("_n") > 0) & (dense > 0) & (chars_among(t, " ") * 2 > dense)).withColumn("_odd", count_of(t, ODD_CHARACTER) * 100 > F.length(t))
    df = df.withColumn("_lost", points((F.col("_fragmented"), 3), (F.col("_short"), 2), (F.col("_spaced"), 2), (F.col("_odd"), 2)))
    blank = F.col("_blank")
    found = listed(*[(F.col(c), n) for c, n in (("_box", "table_detected"), ("_aligned", "aligned_columns"), ("_check", "checkboxes_detected"), ("_structured", "structured_data"), ("_fragmented", "fragmented_words"), ("_short", "short_words"), ("_spaced", "spacing_corruption"), ("_odd", "encoding_issues"))])
    df = df.withColumn("has_tables", ~blank & (F.col("_box") | F.col("_aligned"))).withColumn("has_checkboxes", ~blank & F.col("_check")).withColumn("has_structured", ~blank & F.col("_structured"))
    df = df.withColumn("quality_score", F.when(blank, 0.0).otherwise((10 - F.col("_lost")) / 10)).withColumn("text_quality", ladder((blank, "missing"), (F.col("_lost") > 3, "poor"), (F.col("_lost") > 1, "fair"), otherwise="good"))
    df = df.withColumn("indicators", F.when(blank, F.array(F.lit("no_text_extracted"))).otherwise(found))
    return df.drop("_blank", "_box", "_aligned", "_check", "_structured", "_n", "_single", "_letters", "_fragmented", "_short", "_spaced", "_odd", "_lost")


VISUAL = {"v_tables": "boolean", "v_charts": "boolean", "v_forms": "boolean", "v_layout": "string", "v_image": "string"}


def route(df: DataFrame, used: Column | int = 0, quota: int = QUOTA) -> DataFrame:
    """Analysed pages with method, confidence, elements and reasoning. Visual columns (VISUAL) may be null or missing: then only
    the text counts. A used-up quota comes first."""
    for name, kind in VISUAL.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    c, spent = F.col, (used if isinstance(used, Column) else F.lit(used)) >= quota
    layout, poor_image = flag(c("v_layout").isin("moderate", "complex")), flag(c("v_image") == "poor")
    poor, missing = c("text_quality") == "poor", c("text_quality") == "missing"
    checks = [
        (flag(c("v_tables")), "table", F.lit("tables detected in image")),
        (flag(c("v_charts")), "chart", F.lit("charts/graphs detected")),
        (flag(c("v_forms")), "forms", F.lit("form elements detected")),
        (layout, "complex_layout", F.concat("v_layout", F.lit(" layout"))),
        (poor_image, "poor_image_quality", F.lit("poor image quality detected")),
        (flag(c("has_tables")), "table_text", F.lit("table patterns in extracted text")),
        (flag(c("has_checkboxes")), "checkbox", F.lit("checkbox patterns detected")),
        (poor, "poor_text", F.lit("poor text extraction quality")),
    ]
    df = df.withColumn("elements", listed(*[(x, n) for x, n, _ in checks])).withColumn("_why", F.array_join(listed(*[(x, r) for x, _, r in checks]), ", "))
    strong = F.arrays_overlap("elements", F.array(*[F.lit(x) for x in ("table", "chart", "forms", "checkbox")]))
    weak = poor | poor_image | (c("quality_score") < 0.7) | missing
    clean = (c("text_quality") == "good") & (F.size("elements") == 0)
    base = F.when(poor_image, 7).otherwise(8)
    scanned = F.concat_ws(", ", F.when(c("_why") != "", c("_why")), F.when(missing, "minimal/no text extracted - likely image-based document"))
    df = df.withColumn("method", ladder((spent, "tesseract"), (strong | weak, "vision"), otherwise="tesseract"))
    df = df.withColumn("confidence", ladder((spent, 9), (strong, base), (weak & missing, base), (weak, base - 1), (clean, 9), otherwise=7) / 10)
    told = F.when(c("_why") != "", c("_why")).otherwise("standard processing")
    df = df.withColumn("reasoning", ladder((spent, f"Vision limit reached ({quota}), using Tesseract"), (strong, F.concat(F.lit("Visual elements require vision OCR: "), "_why")), (weak, F.concat(F.lit("Text quality issues detected: "), scanned)), (clean, "Clean text with no visual elements, optimal for Tesseract"), otherwise=F.concat(F.lit("Conservative routing to Tesseract: "), told)))
    names = ladder((spent, F.array(F.lit("vision_limit_reached"))), (~strong & ~weak & clean, F.array(F.lit("clean_text"))), otherwise=c("elements"))
    return df.withColumn("elements", names).drop("_why")


def with_override(pages: DataFrame, settings: DataFrame) -> DataFrame:
    """pages with `override` (vision, tesseract or null) from cleaned settings; an overridden page needs no analysis."""
    one = settings.groupBy("doc_id", "page_no").agg(F.max("setting").alias("setting"))
    return pages.join(one, ["doc_id", "page_no"], "left").withColumn("override", F.when(F.col("setting") == "YES", "vision").when(F.col("setting") == "NO", "tesseract")).drop("setting")


def with_quota(pages: DataFrame, quota: int = QUOTA, cost: Column | int = 1, seed: Column | int = 0) -> DataFrame:
    """pages with used_before and over_quota: calls that the document's earlier pages took, in page order, plus the seed."""
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    cost = cost if isinstance(cost, Column) else F.lit(cost)
    used = F.coalesce(F.sum(cost).over(before), F.lit(0)) + (seed if isinstance(seed, Column) else F.lit(seed))
    return pages.withColumn("used_before", used.cast("long")).withColumn("over_quota", F.col("used_before") >= quota)


def routed(pages: DataFrame, settings: DataFrame, quota: int = QUOTA) -> DataFrame:
    """The routing of all pages of documents: override, else quota in page order, else the ladder."""
    marked = with_override(pages, settings)
    marked = with_quota(marked, quota, F.when(F.col("override").isNull(), 1).otherwise(0))
    out = route(analyse_pages(marked), F.col("used_before"), quota)
    return out.withColumn("method", F.coalesce("override", "method")).withColumn("use_vision", F.col("method") == "vision")


def resolve_attempts(pages: DataFrame, attempts: DataFrame) -> DataFrame:
    """pages with chosen_method and content: a successful vision attempt, else the page's own text if not blank, else a
    successful tesseract attempt, else empty."""
    best = attempts.where("success").groupBy("doc_id", "page_no", "method").agg(F.min_by("content", "attempt").alias("content"))
    of = lambda m: best.where(F.col("method") == m).select("doc_id", "page_no", F.coalesce("content", F.lit("")).alias(m))
    df = pages.join(of("vision"), ["doc_id", "page_no"], "left").join(of("tesseract"), ["doc_id", "page_no"], "left")
    own = F.when(strip(text_of()) != "", F.col("text"))
    df = df.withColumn("chosen_method", ladder((F.col("vision").isNotNull(), "vision"), (own.isNotNull(), "direct"), (F.col("tesseract").isNotNull(), "tesseract"), otherwise="none"))
    return df.withColumn("content", F.coalesce("vision", own, "tesseract", F.lit(""))).drop("vision", "tesseract")


def page_heuristic(metrics: DataFrame) -> DataFrame:
    """metrics (text_len, images, drawings, blocks) with recommendation, confidence and heuristic: the first rule that fits."""
    n, images, drawings, blocks = (F.coalesce(F.col(c), F.lit(0)) for c in ("text_len", "images", "drawings", "blocks"))
    dense = (drawings > 100) | (drawings * 100 > F.greatest(n, F.lit(1)) * 20)
    steps = [((n < 50) & (images == 0), "NO", 95, "Nearly blank page"), (images > 0, "YES", 90, "Contains images"), (dense, "YES", 85, "Contains graphics/charts"), (n > 500, "NO", 85, "Text-rich page"), (blocks > 30, "YES", 70, "Complex layout"), (n > 200, "NO", 75, "Standard text page")]
    pick = lambda k, rest: ladder(*[(s[0], s[k]) for s in steps], otherwise=rest)
    return metrics.withColumn("recommendation", pick(1, "UNCERTAIN")).withColumn("confidence", pick(2, 50) / 100).withColumn("heuristic", pick(3, "Needs analysis"))


def escalate(rated: DataFrame, second: DataFrame) -> DataFrame:
    """Heuristic verdicts above 0.8 stand; others take the second rater's (page_id, s_recommendation, s_confidence, s_reason),
    whose gaps are YES, 0.7 and an empty reason, and whose absence is YES at 0.5. Reasons are cut to 50 characters."""
    sure = F.col("confidence") > 0.8
    both = rated.join(second.withColumn("_found", F.lit(True)), "page_id", "left")
    found = F.col("_found").isNotNull()
    out = both.withColumn("final", ladder((sure, F.col("recommendation")), (found, F.coalesce("s_recommendation", F.lit("YES"))), otherwise="YES"))
    out = out.withColumn("final_confidence", ladder((sure, F.col("confidence")), (found, F.coalesce("s_confidence", F.lit(0.7))), otherwise=0.5))
    out = out.withColumn("method", F.when(sure, "heuristic").otherwise("vision")).withColumn("reason", F.substring(ladder((sure, F.col("heuristic")), (found, F.coalesce("s_reason", F.lit(""))), otherwise="analysis failed"), 1, 50))
    return out.drop("_found")


def recommendation_summary(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of final verdicts and methods for each key; null verdicts count for neither, null keys are one key."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return rows.groupBy(key).agg(count(F.col("final") == "YES").alias("yes_pages"), count(F.col("final") == "NO").alias("no_pages"), count(F.col("method") == "heuristic").alias("heuristic_pages"), count(F.col("method") == "vision").alias("vision_pages"))


def isolate_errors(pages: DataFrame, attempts: DataFrame) -> DataFrame:
    """Every page with content or a placeholder, and success: a failing page never fails its document."""
    last = attempts.groupBy("doc_id", "page_no").agg(F.max("success").alias("ok"), F.min_by("content", F.when(F.col("success"), F.col("attempt"))).alias("content"))
    df = pages.select("doc_id", "page_no").join(last, ["doc_id", "page_no"], "left")
    head = F.concat(F.lit("## Page "), F.col("page_no").cast("string"), F.lit("\n\n"))
    content = ladder((F.col("ok").isNull(), F.concat(head, F.lit("[No text extracted]"))), (~F.col("ok"), F.concat(head, F.lit("[Error: extraction failed]"))), (strip(text_of("content")) == "", F.concat(head, F.lit("[No text extracted]"))), otherwise=F.col("content"))
    return df.withColumn("success", flag(F.col("ok"))).withColumn("content", content).drop("ok")


def is_object(column: str) -> Column:
    """Whether the whole text of a column is a JSON object."""
    return flag(F.expr(f"{column} like '{{%' and try_parse_json({column}) is not null"))


def first_object(text: Column) -> Column:
    """The first balanced {...} of a text, braces in strings not counted; an unbalanced rest is closed. Null without a brace.

    A fold over braces, quotes and backslashes alone: each token is one of them with the plain characters before it.
    """
    start = F.instr(text, "{")
    rest = F.substring(text, start, F.length(text))
    tokens = F.regexp_extract_all(rest, F.lit(r'(?s)[^"{}\\]*+["{}\\]'), F.lit(0))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(False).alias("done"))

    def step(a: Column, t: Column) -> Column:
        # an escape reaches the next character only
        inside, c, escaped = a["quoted"], F.right(t, F.lit(1)), a["escaped"] & (F.length(t) == 1)
        quote = (c == '"') & ~escaped
        depth = a["depth"] + F.when(inside, 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        moved = F.struct((a["n"] + F.length(t)).alias("n"), depth.alias("depth"), F.when(quote, ~inside).otherwise(inside).alias("quoted"), (inside & (c == "\\") & ~escaped).alias("escaped"), ((depth == 0) & ~inside).alias("done"))
        return F.when(a["done"], a).otherwise(moved)

    end = F.aggregate(tokens, zero, step)
    cut = F.when(end["done"], F.substring(rest, F.lit(1), end["n"])).otherwise(rest)
    closed = F.concat(cut, F.when(end["quoted"], '"').otherwise(""), F.repeat(F.lit("}"), F.when(end["done"], 0).otherwise(F.greatest(end["depth"], F.lit(0)))))
    return F.when(start > 0, closed)


VISUAL_SCHEMA = "has_tables boolean, has_charts boolean, has_forms boolean, layout_complexity string, image_quality string"


def parse_visual(responses: DataFrame, column: str = "response") -> DataFrame:
    """responses with visual flags: from JSON, fenced or truncated, else from keywords of the reply."""
    bare = strip(F.regexp_replace(text_of(column), r"```(?:json)?", ""))
    df = responses.withColumn("_bare", bare).withColumn("_json", F.when(is_object("_bare"), F.col("_bare")).otherwise(first_object(F.col("_bare")))).withColumn("_v", F.from_json("_json", VISUAL_SCHEMA))
    parsed = flag(F.expr("try_parse_json(_json) is not null"))
    low = F.lower(text_of(column))
    word = lambda field, *keys: F.when(parsed, flag(F.col(f"_v.{field}"))).otherwise(_any(low, keys))
    df = df.withColumn("parsed", parsed).withColumn("v_tables", word("has_tables", "table")).withColumn("v_charts", word("has_charts", "chart", "graph")).withColumn("v_forms", word("has_forms", "form", "checkbox"))
    df = df.withColumn("v_layout", F.when(parsed, F.coalesce("_v.layout_complexity", F.lit("simple"))).otherwise("moderate")).withColumn("v_image", F.when(parsed, F.coalesce("_v.image_quality", F.lit("good"))).otherwise("good"))
    return df.drop("_bare", "_json", "_v")
