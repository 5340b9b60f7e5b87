"""Reading rating reports of free layout: sections opened by `<RATER> EVALUATION` lines, closed by end marks or by rules of `=`.

A report is cut at the lines that open or close a section, all inside its row, so nothing is shuffled and the work grows with the
text. Null reports count as empty ones. Columns of the caller's may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ladder, lines, strip, text_of

#: The marks of sections, what stands for a missing report, and how far a value stands from its mark.
MARK = "EVALUATION"
END_MARKS = ("DEBUG INFORMATION", "EVALUATOR COMPARISON")
NO_REPORT = "*No evaluation report available*"
NEAR_LINES = 9
RULE_SIGNS = 10


def _after(line: Column, label: str) -> Column:
    """What stands after the label's first occurrence, up to its next."""
    return strip(F.get(F.split(line, label), F.lit(1)))


def shown_score(line: Column) -> Column:
    """`n/100` of the line `Score: n/...`; a line without a value gives `/100`, null `N/A`."""
    return F.coalesce(F.concat(strip(F.substring_index(_after(line, "Score:"), "/", 1)), F.lit("/100")), F.lit("N/A"))


def shown_recommendation(line: Column) -> Column:
    """The first word after `Recommendation:`; UNKNOWN without one."""
    return F.coalesce(F.nullif(F.regexp_substr(_after(line, "Recommendation:"), F.lit(r"^\S+")), F.lit("")), F.lit("UNKNOWN"))


def average_of(text: Column) -> Column:
    """What stands after the first `Average:` in its line; Unknown without one."""
    return F.coalesce(_after(F.get(F.filter(lines(F.coalesce(text, F.lit(""))), lambda x: x.contains("Average:")), F.lit(0)), "Average:"), F.lit("Unknown"))


def layout_of(text: Column, raters: Sequence[str]) -> Column:
    """none for a blank text or its placeholder, dual if every rater has a section, else single."""
    t = F.coalesce(text, F.lit(""))
    every = F.lit(True)
    for r in raters:
        every = every & t.contains(f"{r} {MARK}")
    return ladder((strip(t).isin("", NO_REPORT), "none"), (every, "dual"), otherwise="single")


def _first(found: Column, label: str) -> Column:
    return F.get(F.filter(found, lambda x: x.contains(label)), F.lit(0))


def _near(own: Column, rater: str) -> Column:
    """The lines after a rater's first mark: nine at most, the first mark of another rater being the last."""
    at = F.array_position(F.transform(own, lambda x: x.contains(f"{rater} {MARK}")), True).cast("int")
    ahead = F.slice(own, at + 1, F.lit(NEAR_LINES))
    other = F.array_position(F.transform(ahead, lambda x: x.contains(MARK) & ~x.contains(rater)), True).cast("int")
    return F.when(at > 0, F.when(other > 0, F.slice(ahead, F.lit(1), other)).otherwise(ahead)).otherwise(F.array().cast("array<string>"))


def _sections(text: Column, mark: str) -> Column:
    """The text cut before each line that has what `mark`, a pattern from a line's start, says; linear in the text."""
    return F.split(text, rf"\n(?={mark})")


def _line_with(*words: str) -> str:
    return "".join(rf"(?=[^\n]*{re.escape(w)})" for w in words)


def _ruled(text: Column, rater: str) -> Column:
    """The lines of a rater's sections, each from a line with its name and the mark up to a rule of over ten `=`."""
    name = rater.upper()
    parts = _sections(text, rf"(?:{_line_with(name, MARK)}|(?:[^=\n]*+=){{{RULE_SIGNS + 1}}})")
    first = lambda s: F.substring_index(s, "\n", 1)
    mine = F.filter(parts, lambda s: first(s).contains(name) & first(s).contains(MARK))
    return F.flatten(F.transform(mine, lambda s: F.filter(lines(s), lambda _, i: i > 0)))


def rater_values(reports: DataFrame, raters: Sequence[str], how: str = "near", report: str = "report") -> DataFrame:
    """doc_id, rater, score and recommendation of each rater of each report.

    near takes the first values within nine lines of the rater's first mark, and stops at another rater's; ruled takes the first ones
    in any section of the rater's, which end at rules of `=`. What is not found is N/A and UNKNOWN. Rows that repeat a doc_id are
    read each.
    """
    if how not in ("near", "ruled"):
        raise ValueError(f"unknown way of reading: {how}")
    own = reports.select("doc_id", text_of(report).alias("own"))
    part = {"near": lambda t, r: _near(lines(t), r), "ruled": _ruled}[how]
    found = own.select("doc_id", F.explode(F.array(*[F.struct(F.lit(r).alias("rater"), part(F.col("own"), r).alias("found")) for r in raters])).alias("x"))
    found = found.select("doc_id", "x.rater", _first(F.col("x.found"), "Score:").alias("s"), _first(F.col("x.found"), "Recommendation:").alias("r"))
    return found.select("doc_id", "rater", shown_score(F.col("s")).alias("score"), shown_recommendation(F.col("r")).alias("recommendation"))


def split_reports(reports: DataFrame, raters: Sequence[str], ends: Sequence[str] = END_MARKS, report: str = "report") -> DataFrame:
    """doc_id, rater and body: all lines of a rater's sections, each under `## <Rater> Evaluation`, up to the next rater's mark or an
    end mark; null for a rater without a section. A line with several marks counts for the first rater of the list."""
    marks = [*[f"{r} {MARK}" for r in raters], *ends]
    parts = reports.select("doc_id", _sections(text_of(report), "(?:" + "|".join(map(_line_with, marks)) + ")").alias("parts"))
    first = lambda s: F.substring_index(s, "\n", 1)
    kind = lambda s: ladder(*[(first(s).contains(m), i) for i, m in enumerate(marks)])

    def body(i: int, rater: str) -> Column:
        mine = F.filter("parts", lambda s: kind(s) == i)
        head = F.lit(f"## {rater.title()} Evaluation")
        return F.when(F.size(mine) > 0, F.array_join(F.transform(mine, lambda s: F.concat(head, F.substring(s, F.length(first(s)) + 1, F.length(s)))), "\n"))

    return parts.select("doc_id", F.explode(F.array(*[F.struct(F.lit(r).alias("rater"), body(i, r).alias("body")) for i, r in enumerate(raters)])).alias("x")).select("doc_id", "x.*")


def report_overview(reports: DataFrame, report: str = "report", raters: Sequence[str] = ("RATER A", "RATER B")) -> DataFrame:
    """doc_id, layout and average of each report."""
    t = F.col(report)
    return reports.select("doc_id", layout_of(t, raters).alias("layout"), average_of(t).alias("average"))
