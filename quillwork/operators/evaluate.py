"""Rating of converted documents: parsing of replies, missing and added content, comparison of two raters, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import flag, ladder, lines, strip, text_of
from .routing import first_object, is_object

RANKS = {"ACCEPT": 0, "REVIEW": 1, "REJECT": 2}
REPLY = "overall_score double, recommendation string, missing_items array<struct<content:string>>, added_items array<struct<content:string>>, summary string"


def parse_ratings(raw: DataFrame, column: str = "response") -> DataFrame:
    """raw with score, recommendation, missing, added (arrays of texts) and how the reply was read.

    In this order: the whole reply as JSON, its fenced block, its first balanced object, else a score and the first of ACCEPT,
    REVIEW, REJECT found in the text; nothing found gives 0.0 and REVIEW.
    """
    t = text_of(column)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    df = raw.withColumn("_whole", strip(t)).withColumn("_fenced", fenced)
    df = df.withColumn("_known", ladder((is_object("_whole"), "whole"), (is_object("_fenced"), "fenced")))
    df = df.withColumn("_object", F.when(F.col("_known").isNull(), first_object(t)))
    df = df.withColumn("read_as", F.coalesce("_known", F.when(is_object("_object"), "object"), F.lit("text")))
    df = df.withColumn("_json", ladder(*[(F.col("read_as") == k, F.col(f"_{k}")) for k in ("whole", "fenced", "object")])).withColumn("_v", F.from_json("_json", REPLY))
    loose = F.regexp_extract(t, r"(?i)overall_score[\"\s:]+([0-9]+\.?[0-9]*)", 1).try_cast("double")
    word = ladder(*[(F.upper(t).contains(k), k) for k in RANKS], otherwise="REVIEW")
    parsed = F.col("read_as") != "text"
    items = lambda f: F.when(parsed, F.coalesce(F.transform(F.col(f"_v.{f}"), lambda x: F.coalesce(x["content"], F.lit(""))), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("score", F.coalesce(F.when(parsed, F.col("_v.overall_score")).otherwise(loose), F.lit(0.0)))
    df = df.withColumn("recommendation", F.when(parsed, F.coalesce("_v.recommendation", F.lit("REVIEW"))).otherwise(word))
    return df.withColumn("missing", items("missing_items")).withColumn("added", items("added_items")).drop("_whole", "_fenced", "_known", "_object", "_json", "_v")


def _items(text: str) -> Column:
    """Distinct normal lines: lower case, one space between words, blank lines and bare page marks left out."""
    flat = F.lower(F.regexp_replace(text_of(text), r"[\t\f\r\x0B\x{85}\p{Z}]+", " "))
    own = F.transform(lines(flat), lambda x: F.trim(x))
    return F.array_distinct(F.filter(own, lambda x: (x != "") & ~x.rlike(r"^(page )?[0-9]+( of [0-9]+)?$|^-+$")))


def missing_items(pairs: DataFrame, source: str = "text", output: str = "formatted") -> DataFrame:
    """doc_id and item: normal lines of the source that its output lacks, in any order. Both texts are in one row, so nothing is
    shuffled; each row is taken by itself, whatever doc_id it repeats. Null texts count as empty."""
    return pairs.select("doc_id", F.explode(F.array_except(_items(source), _items(output))).alias("item"))


def added_items(pairs: DataFrame, source: str = "text", output: str = "formatted") -> DataFrame:
    """doc_id and item: normal lines of the output that its source lacks."""
    return missing_items(pairs, output, source)


def recommendation_of(score: Column) -> Column:
    return ladder((score >= 90, "ACCEPT"), (score >= 70, "REVIEW"), otherwise="REJECT")


def rate_documents(pairs: DataFrame) -> DataFrame:
    """One evaluation a row of pairs: coverage of source lines in percent, its recommendation, and counts of items. A document
    without lines counts as covered; null texts count as empty, and rows that repeat a doc_id are rated each."""
    df = pairs.select("doc_id", _items("text").alias("a"), _items("formatted").alias("b"))
    df = df.select("doc_id", F.size("a").cast("long").alias("n_lines"), F.size(F.array_except("a", "b")).cast("long").alias("n_missing"), F.size(F.array_except("b", "a")).cast("long").alias("n_added"))
    df = df.withColumn("score", F.when(F.col("n_lines") > 0, (F.col("n_lines") - F.col("n_missing")) * 100 / F.col("n_lines")).otherwise(100.0))
    return df.withColumn("recommendation", recommendation_of(F.col("score")))


def item_overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap in percent of two lists of texts, compared trimmed and in lower case; both empty 100, one empty 0."""
    x, y = (F.array_distinct(F.transform(c, lambda v: strip(F.lower(v)))) for c in (a, b))
    return ladder(((F.size(a) == 0) & (F.size(b) == 0), 100.0), ((F.size(a) == 0) | (F.size(b) == 0), 0.0), otherwise=F.size(F.array_intersect(x, y)) * 100 / F.size(F.array_union(x, y)))


def _rank(c: Column) -> Column:
    return ladder(*[(c == k, v) for k, v in RANKS.items()])


def compare_raters(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row a document that `first` rates: final score (the mean, or the one given), agreement, recommendation, gap,
    overlaps, whether recommendations match or are adjacent, and a summary. Without a second rating agreement is 100."""
    b = second.select("doc_id", *[F.col(c).alias(f"b_{c}") for c in ("score", "recommendation", "missing", "added")])
    df = first.select("doc_id", "score", "recommendation", "missing", "added").join(b, "doc_id", "left")
    both, c = F.col("b_score").isNotNull(), F.col
    mean = (c("score") + c("b_score")) / 2
    df = df.withColumn("final_score", F.when(both, mean).otherwise(c("score"))).withColumn("agreement", F.when(both, mean).otherwise(100.0))
    df = df.withColumn("final_recommendation", F.when(both, recommendation_of(mean)).otherwise(c("recommendation"))).withColumn("gap", F.when(both, F.abs(c("score") - c("b_score"))).otherwise(0.0))
    df = df.withColumn("same", flag(c("recommendation") == c("b_recommendation"))).withColumn("adjacent", flag(F.abs(_rank(c("recommendation")) - _rank(c("b_recommendation"))) == 1))
    df = df.withColumn("missing_overlap", F.when(both, item_overlap(c("missing"), c("b_missing")))).withColumn("added_overlap", F.when(both, item_overlap(c("added"), c("b_added"))))
    told = F.concat(F.lit("final "), F.format_number("final_score", 1), F.lit(" "), c("final_recommendation"), F.when(both & ~c("same"), " (raters disagree)").otherwise(""))
    return df.withColumn("summary", told)


def eval_report(compared: DataFrame, a: str = "Rater A", b: str = "Rater B") -> DataFrame:
    """doc_id and report: sections in fixed order with numbered items."""
    c = F.col
    numbered = lambda items: F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")).otherwise("None")
    part = lambda name, score, rec, lost, new: F.concat(F.lit(f"## {name}\nScore: "), F.format_number(score, 1), F.lit("/100\nRecommendation: "), rec, F.lit("\nMissing:\n"), numbered(lost), F.lit("\nAdded:\n"), numbered(new))
    second = F.when(c("b_score").isNotNull(), part(b, c("b_score"), c("b_recommendation"), c("b_missing"), c("b_added"))).otherwise(F.lit(f"## {b}\nNot available"))
    last = F.concat(F.lit("## Final\nAverage: "), F.format_number("final_score", 1), F.lit("/100\nRecommendation: "), c("final_recommendation"))
    return compared.select("doc_id", F.concat_ws("\n\n", part(a, c("score"), c("recommendation"), c("missing"), c("added")), second, last).alias("report"))


def parse_report(reports: DataFrame) -> DataFrame:
    """doc_id, section, score and recommendation read back from reports: the first of each within a section's next nine lines."""
    rows = reports.select("doc_id", F.posexplode(lines(text_of("report"))).alias("i", "line"))
    ahead = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").startswith("## ")
    rows = rows.withColumn("section", F.last(F.when(head, F.expr("substring(line, 4)")), True).over(ahead)).withColumn("at", F.last(F.when(head, F.col("i")), True).over(ahead))
    near = rows.where((F.col("i") - F.col("at")).between(1, 9))
    score = F.regexp_extract("line", r"^(?:Score|Average): ([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    rec = F.nullif(F.regexp_extract("line", r"^Recommendation: ([A-Z]+)", 1), F.lit(""))
    return near.groupBy("doc_id", "section").agg(F.min_by(score, F.when(score.isNotNull(), F.col("i"))).alias("score"), F.min_by(rec, F.when(rec.isNotNull(), F.col("i"))).alias("recommendation"))


def sample_pages(pages: DataFrame, most: int = 5) -> DataFrame:
    """The first pages of each document, for rating."""
    first = Window.partitionBy("doc_id").orderBy("page_no")
    return pages.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).drop("_n")
