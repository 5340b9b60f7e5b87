"""Pieces of the SQL that queries are held against, in DuckDB's dialect."""

from __future__ import annotations

from ..functions.text import S, W
from ..sources.derived import BLOCKS, LINES_PER_PAGE


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(S + '+')}), lambda w: w <> '')"


def lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + S + '+|' + S + '+' + chr(92) + 'z')}, '', 'g')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def among(x: str, chars: str) -> str:
    return f"(length({x}) - length(translate({x}, {q(chars)}, '')))"


def rlike(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def case(*steps: tuple[str, str], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in steps) + f" ELSE {otherwise} END"


_block = "CAST([" + ", ".join(q(b) for b in BLOCKS) + f"] AS VARCHAR[])[CAST(((doc_id % 16) + 16) % 16 AS INT) + 1]"
DOCS = f"docs_aug AS (SELECT doc_id, CASE WHEN {_block} = '' THEN coalesce(text, '') ELSE coalesce(text, '') || chr(10) || {_block} END AS text FROM documents)"
PAGES = f"""{DOCS}, doc_pages AS (SELECT doc_id, CAST(p + 1 AS BIGINT) AS page_no, array_to_string(list_slice({lines('text')}, CAST(p * {LINES_PER_PAGE} + 1 AS BIGINT), CAST(p * {LINES_PER_PAGE} + {LINES_PER_PAGE} AS BIGINT)), chr(10)) AS text
  FROM (SELECT doc_id, text, unnest(range(CAST((len({lines('text')}) + {LINES_PER_PAGE} - 1) // {LINES_PER_PAGE} AS BIGINT))) AS p FROM docs_aug))"""
__all__ = ["DOCS", "PAGES", "S", "W", "among", "case", "count", "lines", "q", "rlike", "strip", "words"]
