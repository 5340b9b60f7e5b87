"""Keyword summaries, paragraph ranking and truncation to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, strip, text_of, words

#: Keyword lists, matched as substrings in lower case.
LINE_KEYWORDS = ("benefit", "benefits", "coverage", "eligible", "eligibility", "payment", "payments", "amount", "premium", "deductible", "qualify", "qualification", "requirement", "requirements")
PARAGRAPH_KEYWORDS = (
    "benefit", "eligible", "eligibility", "coverage", "payment", "amount", "qualify", "requirement", "criteria", "enrollment",
    "deductible", "copay", "premium", "maximum", "minimum", "percentage", "duration", "period", "effective", "termination",
)
SUMMARY_KEYWORDS = ("benefit", "eligible", "coverage", "payment", "amount", "qualify", "requirement", "criteria", "duration", "limit", "percentage", "$")
MOST_LINES = 10
NOTICE = "\n\n[Content truncated to its most relevant paragraphs]"


def _hits(text: Column, keywords) -> Column:
    low = F.lower(text)
    return sum((F.when(low.contains(k), 1).otherwise(0) for k in keywords), F.lit(0))


def keyword_lines(docs: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """doc_id, summary, n_found: trimmed lines over 20 characters with a keyword, the first `most` in order as a list, and a count
    of the rest; a notice without any."""
    kept = F.filter(F.transform(lines(text_of()), strip), lambda x: (F.length(x) > 20) & (_hits(x, LINE_KEYWORDS) > 0))
    df = docs.select("doc_id", kept.alias("k")).withColumn("n_found", F.size("k").cast("long"))
    listed = F.array_join(F.transform(F.slice("k", 1, most), lambda x: F.concat(F.lit("- "), x)), "\n")
    more = F.when(F.col("n_found") > most, F.concat(F.lit("\n"), (F.col("n_found") - most).cast("string"), F.lit(" more"))).otherwise("")
    return df.select("doc_id", F.when(F.col("n_found") > 0, F.concat(listed, more)).otherwise("No specific information was identified.").alias("summary"), "n_found")


def _ranked(text: Column) -> Column:
    """Paragraphs as (score, pos, text), best first, equals in text order."""
    parts = F.transform(F.split(text, "\n\n"), lambda p, i: F.struct((-(_hits(p, PARAGRAPH_KEYWORDS) + F.when(p.contains("$"), 2).otherwise(0) + F.when(p.contains("%"), 1).otherwise(0))).alias("s"), i.alias("pos"), p.alias("p")))
    return F.array_sort(F.filter(parts, lambda x: strip(x["p"]) != ""))


def paragraph_rank(docs: DataFrame) -> DataFrame:
    """doc_id, pos, score, rank of each paragraph that is not blank."""
    df = docs.select("doc_id", F.posexplode(_ranked(text_of())).alias("r", "x"))
    return df.select("doc_id", F.col("x.pos").cast("long").alias("pos"), (-F.col("x.s")).cast("long").alias("score"), (F.col("r") + 1).cast("long").alias("rank"))


def smart_truncate(docs: DataFrame, budget: int) -> DataFrame:
    """doc_id and text cut to `budget` characters: ranked paragraphs that fit (two characters more each) are taken; the first that
    does not fit, while under 80 % is used and over 100 characters remain, is cut, at its last sentence end past half, and ends
    the fill; others are passed over. A notice tells of what is left out."""
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("done"))

    def fill(a: Column, x: Column) -> Column:
        p, size = x["p"], F.length(x["p"]) + 2
        room = F.lit(budget) - a["used"] - 50
        cut = F.substring(p, F.lit(1), room)
        end = F.length(cut) - F.instr(F.reverse(cut), " .")
        sentence = F.when((F.instr(F.reverse(cut), " .") > 0) & ((end - 1) * 2 > room), F.substring(cut, F.lit(1), end)).otherwise(cut)
        take = F.struct(F.concat(a["out"], F.array(p)).alias("out"), (a["used"] + size).alias("used"), F.lit(False).alias("done"))
        last = F.struct(F.concat(a["out"], F.array(sentence)).alias("out"), a["used"].alias("used"), F.lit(True).alias("done"))
        return F.when(a["done"], a).when(a["used"] + size <= budget, take).when((a["used"] * 10 < budget * 8) & (room > 100), last).otherwise(a)

    text = text_of()
    df = docs.select("doc_id", text.alias("t"), F.aggregate(_ranked(text), zero, fill)["out"].alias("out")).withColumn("text", F.array_join("out", "\n\n"))
    return df.select("doc_id", F.when(F.length("text") < F.length("t"), F.concat("text", F.lit(NOTICE))).otherwise(F.col("text")).alias("text"))


def summary_confidence(df: DataFrame, summary: str = "summary") -> DataFrame:
    """df with summary_confidence: keywords, length and structure, in 0.1 to 1; summaries under 50 characters 0.1."""
    t = text_of(summary)
    n = F.length(t)
    structure = sum((F.when(c, v).otherwise(0) for c, v in ((t.contains("##"), 3), (t.contains("- ") | t.contains("* "), 2), (t.rlike(r"\p{Nd}"), 2))), F.lit(0))
    # in units of 1 / 6000: 0.4 / 12 a keyword, 0.3 / 500 a character, 0.03 a structure point
    units = _hits(t, SUMMARY_KEYWORDS) * 200 + F.least(n, F.lit(500)) * F.lit(18) / 5 + structure * 180
    return df.withColumn("summary_confidence", F.when(n < 50, 0.1).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), units / 6000))))


def summary_stats(df: DataFrame) -> DataFrame:
    """df (text, summary) with lengths, words and compression in percent, to one decimal."""
    a, b = text_of(), text_of("summary")
    share = F.when(F.length(a) > 0, F.format_number((F.length(a) - F.length(b)) * 100 / F.length(a), 1)).otherwise("0.0")
    return df.withColumn("original_length", F.length(a).cast("long")).withColumn("summary_length", F.length(b).cast("long")).withColumn("original_words", F.size(words(a)).cast("long")).withColumn("summary_words", F.size(words(b)).cast("long")).withColumn("compression", share)


def resolve_summaries(docs: DataFrame, supplied: DataFrame) -> DataFrame:
    """doc_id, summary, method, ok: a supplied successful summary that is not empty, else keyword lines; a blank text gives a
    notice and is not ok."""
    # of several supplied summaries the least counts; rows that repeat a doc_id keep their own text's lines
    given = supplied.where("success").groupBy("doc_id").agg(F.min(F.nullif(strip(text_of("summary")), F.lit(""))).alias("given"))
    own = docs.select(F.struct("doc_id", (strip(text_of()) == "").alias("blank")).alias("doc_id"), "text")
    df = keyword_lines(own).select("doc_id.*", "summary").join(given, "doc_id", "left")
    return df.select("doc_id", F.when(F.col("blank"), "No content to summarise.").otherwise(F.coalesce("given", "summary")).alias("summary"), F.when(F.col("blank"), "none").when(F.col("given").isNotNull(), "supplied").otherwise("keywords").alias("method"), (~F.col("blank")).alias("ok"))
