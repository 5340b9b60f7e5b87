"""Corruption scores of texts: explainable rules, summed in tenths, with a decision and its reasons.

Every operator is row by row: a text's lines and words are arrays inside the row, so scoring needs no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANK, INDENT, S, W, chars_among, count_of, flag, ladder, line_count, lines, listed, points, strip, text_of, whole_words, word_count

QUOTA = 100
#: Rule patterns and word lists of the scores.
SEPARATORS = "|-_=+"
BORDER = rf"^[|+]?[{BLANK}_=-]"
SPACED = rf"^[{BLANK}_=|-]+$"
JUNCTION = rf"^[{BLANK}+|_=-]+$"
#: Runs of two and more - or _ with blanks between them: what holds, and what does not.
SIMPLE_DASH = (rf"^[{BLANK}_-]+$", S, "^[-_][-_]", "[-_][-_]$")
SINGLE_DASH = rf"{S}[-_]{S}"
SPACE_COLUMNS = rf"{W}{S}{{3,}}{W}"
#: The same for Java's matcher: the blank is tried first, as most characters are none.
SPACE_COLUMNS_BACK = rf"{S}(?<={W}{S}){S}{{2,}}{W}"
DATA = r"[$%\p{Nd}]"
ROW_START = rf"^[A-Z][a-z{BLANK}]+[$%\p{{Nd}}]"
NESTED_HEADER = rf"(?:^|[^a-zA-Z])[a-z]*[A-Z][a-zA-Z]+{S}+[A-Z][a-zA-Z]"
LETTERS_WORD = rf"(?<![^{BLANK}])\p{{L}}{{3,}}(?![^{BLANK}])"
FIVE_WORDS = rf"^(?:[^{BLANK}]+{S}+){{4}}[^{BLANK}]"
SUBSTANTIAL = rf"(?md)^{INDENT}[^{BLANK}].{{19,}}[^{BLANK}]{INDENT}$"
REVERSED_PREFIXES = ("gni", "noi", "eci", "de")
REVERSED_SUFFIXES = ("erp", "bus", "noc", "noit")
REVERSED_WORDS = ("ynapmoc", "ecnarusni", "dradnats")
ODD_CHARACTER = r"[^\p{L}\p{N}_\s\x{85}\p{Z}.,!?;:()\-$%/€£¥'\"&@#*]"
MONEY = r"\$\p{Nd}*00,\p{Nd}{1,2}"
MARKS = "[✓✔√]"
KINDS = ("pure", "border", "spaced", "junction", "simple_dash")
TYPES = ("border", "junction", "pipe_data", "pure", "simple_dash", "space_columns", "spaced")


def line_facts(stripped: str) -> Column:
    """For each line of an array column of stripped lines that is not blank: its separator kind or null, and the counts that the
    table score needs. What a line's facts use more than once is a step of its own, as lambdas share no work."""

    def measured(x: Column, i: Column) -> Column:
        return F.struct(x.alias("x"), i.alias("i"), chars_among(x, SEPARATORS).alias("separators"), chars_among(x, "|").alias("pipes"), x.rlike(SPACE_COLUMNS_BACK).alias("spaced"), x.rlike(DATA).alias("data"))

    def with_kind(m: Column) -> Column:
        x, separators, size = m["x"], m["separators"], F.length(m["x"])
        # counts come first: they spare most lines the patterns
        dashes = (separators >= 4) & reduce(Column.__and__, [x.rlike(p) for p in SIMPLE_DASH]) & ~x.rlike(SINGLE_DASH)
        kind = ladder(
            ((size > 2) & (separators * 10 >= size * 6), "pure"),
            ((separators >= 3) & x.rlike(BORDER), "border"),
            ((separators >= 3) & (size >= 5) & x.rlike(SPACED), "spaced"),
            ((separators >= 3) & x.contains("+") & x.rlike(JUNCTION), "junction"),
            (dashes, "simple_dash"),
        )
        return F.struct(m.alias("m"), kind.alias("kind"))

    def facts(k: Column) -> Column:
        m, kind = k["m"], k["kind"]
        after = F.coalesce(F.get(stripped, m["i"] + 1), F.lit(""))
        # figures are looked for first: they are found or missed faster
        nested = after.rlike(DATA) & m["x"].rlike(NESTED_HEADER)
        pipes, spaced = m["pipes"], m["spaced"]
        # a word of letters alone, beside the word that holds the figure
        mixed = m["data"] & m["x"].rlike(LETTERS_WORD)
        plain = kind.isNull()
        return F.struct(
            nested.cast("int").alias("nested"),
            kind.alias("kind"),
            (plain & (pipes >= 3)).alias("pipe_data"),
            (plain & spaced).alias("space_columns"),
            F.when(plain, points((pipes >= 2, 1), (spaced, 1))).otherwise(0).alias("table"),
            F.when(plain, points((m["data"] & ~m["x"].rlike(FIVE_WORDS), 1), (mixed, 1), (m["x"].rlike(ROW_START), 1))).otherwise(0).alias("figures"),
        )

    measures = F.filter(F.transform(stripped, measured), lambda m: m["x"] != "")
    return F.transform(F.transform(measures, with_kind), facts)


def with_table_score(df: DataFrame, text: str = "text") -> DataFrame:
    """df with table_tenths and table_issue: nested headers, separators, pipe rows and rows of figures, in this order.

    Blank texts score 0. Null texts count as blank.
    """
    total = lambda name: F.aggregate(F.transform("_facts", lambda f: f[name]), F.lit(0), lambda a, x: a + x)
    of = lambda t: F.size(F.filter("_facts", lambda f: f["kind"] == t if t in KINDS else f[t]))
    df = df.withColumn("_stripped", F.transform(lines(text_of(text)), strip)).withColumn("_facts", line_facts("_stripped"))
    df = df.withColumn("_nested", total("nested")).withColumn("_separators", F.size(F.filter("_facts", lambda f: f["kind"].isNotNull())))
    df = df.withColumn("_table", total("table")).withColumn("_figures", total("figures")).withColumn("_lines", F.size("_facts"))
    df = df.withColumn("_types", F.array_join(listed(*[(of(t) > 0, F.concat(F.lit(f"{t}:"), of(t).cast("string"))) for t in TYPES]), ", "))
    s, t, g = F.col("_separators"), F.col("_table"), F.col("_figures")
    say = F.format_string
    steps = [
        (F.col("_nested") >= 1, 10, say("nested_table_headers_detected(%d instances)", "_nested")),
        (s >= 2, 8, say("table_patterns_detected(%d separators: %s)", "_separators", "_types")),
        ((s >= 1) & (t >= 1), 6, say("table_structure_detected(%d separators, %d pipe lines)", "_separators", "_table")),
        ((s >= 1) & (F.col("_lines") >= 3), 5, say("single_separator_table(%d separator, %d total lines: %s)", "_separators", "_lines", "_types")),
        (g >= 5, 5, say("ocr_table_patterns(%d structured data lines)", "_figures")),
        (t >= 3, 4, say("pipe_table_detected(%d pipe-separated lines)", "_table")),
        (g >= 3, 3, say("structured_data_detected(%d data patterns)", "_figures")),
    ]
    df = df.withColumn("table_tenths", ladder(*[(c, n) for c, n, _ in steps], otherwise=0)).withColumn("table_issue", ladder(*[(c, i) for c, _, i in steps]))
    return df.drop("_stripped", "_facts", "_nested", "_separators", "_table", "_figures", "_lines", "_types")


def reversed_words(text: Column) -> Column:
    """How many words of three characters or more, in lower case and without punctuation, look reversed."""
    clean = F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}_{BLANK}]", "")
    starts = "|".join(p if len(p) > 2 else f"{p}[^{BLANK}]" for p in REVERSED_PREFIXES)
    first = "".join(sorted({w[0] for w in (*REVERSED_PREFIXES, *REVERSED_SUFFIXES, *REVERSED_WORDS)}))
    # a word found by its start is passed over whole, others are found by their ends; a look at one character spares most places the rest
    whole, end = f"(?<![^{BLANK}])", f"(?![^{BLANK}])"
    found = f"(?=[{first}])(?:{whole}(?:{starts})[^{BLANK}]*+|(?:{'|'.join(REVERSED_SUFFIXES)}){end}|{whole}(?:{'|'.join(REVERSED_WORDS)}){end})"
    return F.regexp_count(clean, F.lit(found)).cast("long")


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the measures that the other seven scores rest on: counts and ratios of characters, words and lines."""
    t = text_of(text)
    df = df.withColumn("n_words", word_count(t)).withColumn("n_chars_text", F.length(t).cast("long"))
    df = df.withColumn("n_lines", line_count(t)).withColumn("n_spaces", chars_among(t, " ").cast("long"))
    dense = F.length(F.translate(t, " \n", ""))
    df = df.withColumn("spacing", F.when(dense > 0, F.col("n_spaces") / dense).otherwise(F.lit(0.0)))
    df = df.withColumn("n_reversed", reversed_words(t)).withColumn("n_single", whole_words(t, r"\p{L}"))
    df = df.withColumn("n_odd", count_of(t, ODD_CHARACTER)).withColumn("n_money", count_of(t, MONEY)).withColumn("n_marks", count_of(t, MARKS))
    return df.withColumn("n_substantial", F.regexp_count(t, F.lit(SUBSTANTIAL)).cast("long"))


def with_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the eight scores in tenths and their issue texts, in fixed order."""
    df = with_measures(with_table_score(df, text), text)
    c = F.col
    rules = {
        "spacing": (c("spacing") > 0.5, 2, F.concat(F.lit("character_spacing_corruption(ratio:"), F.format_number("spacing", 2), F.lit(")"))),
        "reversed": ((c("n_words") > 0) & (c("n_reversed") * 20 > c("n_words")), 6, F.format_string("reversed_words(%d/%d)", "n_reversed", "n_words")),
        "single": ((c("n_words") > 0) & (c("n_single") * 10 > c("n_words")), 2, F.format_string("single_char_words(%d)", "n_single")),
        "encoding": (c("n_odd") * 100 > c("n_chars_text"), 4, F.format_string("encoding_issues(%d)", "n_odd")),
        "financial": (c("n_money") > 0, 2, F.format_string("financial_corruption(%d)", "n_money")),
        "symbols": (c("n_marks") > 0, 5, F.format_string("checkmark_symbols(%d)", "n_marks")),
        "sparsity": (c("n_substantial") < 2, 4, F.format_string("sparse_content(substantial_lines:%d)", "n_substantial")),
    }
    for name, (rule, tenths, issue) in rules.items():
        df = df.withColumn(f"{name}_tenths", F.when(flag(rule), tenths).otherwise(0)).withColumn(f"{name}_issue", F.when(flag(rule), issue))
    return df


SCORES = ("table", "spacing", "reversed", "single", "encoding", "financial", "symbols", "sparsity")


def corruption_score(df: DataFrame, text: str = "text") -> DataFrame:
    """df with eight scores, their total (a plain sum, which may exceed 1) and `issues`."""
    df = with_scores(df, text)
    total = sum((F.col(f"{s}_tenths") for s in SCORES), F.lit(0))
    df = df.withColumn("total_tenths", total).withColumn("issues", F.concat_ws("; ", *[F.col(f"{s}_issue") for s in SCORES]))
    for s in (*SCORES, "total"):
        df = df.withColumn(f"{s}_score", F.col(f"{s}_tenths") / 10)
    return df


def vision_decision(df: DataFrame, text: str = "text", used: Column | int = 0, quota: int = QUOTA, threshold_tenths: int = 1, strict: bool = False) -> DataFrame:
    """df with use_vision and reason: a used-up quota decides first, then the total against the threshold (>= or, strict, >)."""
    df = corruption_score(df, text)
    spent = (used if isinstance(used, Column) else F.lit(used)) >= quota
    over = F.col("total_tenths") > threshold_tenths if strict else F.col("total_tenths") >= threshold_tenths
    clean = F.concat(F.lit("clean_text(score:"), F.format_number("total_score", 2), F.lit(")"))
    reason = ladder((spent, F.lit(f"Vision limit reached ({quota})")), (over & (F.col("issues") != ""), F.col("issues")), otherwise=clean)
    return df.withColumn("use_vision", ~spent & over).withColumn("reason", reason)


def extraction_strategy(df: DataFrame, text: str = "text") -> DataFrame:
    """df with strategy, from the table score and words of the text. Any letter x counts as a form mark."""
    df = with_table_score(df, text)
    low = F.lower(text_of(text))
    has = lambda *marks: F.lit(False) if not marks else low.contains(marks[0]) | has(*marks[1:])
    strategy = ladder((F.col("table_tenths") > 3, "table_focused"), (has("form", "checkbox", "☐", "☑", "x"), "form_focused"), (has("def ", "class ", "import ", "$"), "technical_doc"), otherwise="standard")
    return df.withColumn("strategy", strategy)


def fallback_gate(df: DataFrame, text: str = "text") -> DataFrame:
    """df with gate: `text` for clean texts without tables, else `escalate`. Here the total must exceed the threshold."""
    df = vision_decision(df, text, strict=True)
    return df.withColumn("gate", F.when(~F.col("use_vision") & (F.col("table_tenths") == 0), F.lit("text")).otherwise(F.lit("escalate")))
