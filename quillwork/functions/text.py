"""Text patterns and column helpers that mean the same in every engine.

`W` and `S` stand for word and white-space characters: Unicode letters, digits and _, and all Unicode separators. Patterns use
them instead of \\w and \\s, whose meaning differs between regular-expression dialects.

Lines have any length, and Java's matcher recurses once for each turn of a repeated group with alternatives and starts anew at
each character. So patterns repeat single classes only (`BLANK` is the inside of `S`), and what may start anywhere in a long run
is tied to the run's start.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"[\p{L}\p{N}_]"
BLANK = r"\s\x{85}\p{Z}"
S = f"[{BLANK}]"
#: White space that ends no line: a line's indent.
INDENT = r"[\t\f\r\x0B\x{85}\p{Z}]*"
PAGE_BREAK = "\n\n---PAGE BREAK---\n\n"


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{S}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{BLANK}]+")).cast("long")


def line_count(text: Column) -> Column:
    return (chars_among(text, "\n") + 1).cast("long")


def whole_words(text: Column, pattern: str) -> Column:
    """How many words are all as in the pattern."""
    return F.regexp_count(text, F.lit(f"(?<![^{BLANK}]){pattern}(?![^{BLANK}])")).cast("long")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def once(value: Column, use) -> Column:
    """use(value) with value computed once: the optimiser would copy it to each of its places, also into what runs for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    # most texts have no blank at either end, which two characters tell; the look-behind keeps a long run inside the text from being
    # tried at each of its characters
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(S), F.regexp_replace(text, rf"^{S}+|(?<!{S}){S}+\z", "")).otherwise(text)


def unix(pattern: str) -> str:
    """A pattern whose lines end at \\n only: its multi-line flag gets Java's flag for that."""
    return pattern.replace("(?m)", "(?md)").replace("(?im)", "(?imd)")


def has(text: Column, pattern: str) -> Column:
    return text.rlike(unix(pattern))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(unix(pattern))).cast("long")


def chars_among(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def points(*rules: tuple[Column, int]) -> Column:
    """The sum of the points of the rules that hold, as an integer: scores in tenths are summed exactly and divided once."""
    total: Column = F.lit(0)
    for condition, n in rules:
        total = total + F.when(condition, n).otherwise(0)
    return total


def ladder(*steps: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first step whose condition holds."""
    out: Column | None = None
    for condition, value in steps:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, v) if out is None else out.when(condition, v)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def listed(*items: tuple[Column, object]) -> Column:
    """The values whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(c, v if isinstance(v, Column) else F.lit(v)) for c, v in items]))


def joined(elements: Column, separator: str, order: str = "pos", value: str = "value") -> Column:
    """An aggregate: values of structs (order, value) joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(elements)), lambda x: x[value]), separator)


def title_case(text: Column) -> Column:
    """Upper case for a letter that follows no letter, lower case for all others."""
    chars = F.split(F.lower(text), "")
    def cased(c: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(chars, i - 1)).otherwise(F.lit(" "))
        return F.when(before.rlike(r"\p{L}"), c).otherwise(F.upper(c))
    return F.array_join(F.transform(chars, cased), "")
