"""Queries on text quality, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources.derived import docs_aug
from .sql import DOCS, S, among, case, count, lines, q, rlike, strip
from .sql import words as sql_words

_DASH = rf"^[-_]{{2,}}({S}+[-_]{{2,}})+$"
_facts = f"""{DOCS}, l AS (SELECT doc_id, unnest({lines('text')}) AS raw, generate_subscripts({lines('text')}, 1) AS i FROM docs_aug),
s AS (SELECT doc_id, i, {strip('raw')} AS x, lead({strip('raw')}) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM l),
m AS (SELECT *, {among('x', Q.SEPARATORS)} AS sep, length(x) AS n, {among('x', '|')} AS pipes, {sql_words('x')} AS ws FROM s WHERE x <> ''),
k AS (SELECT *, {case(('n > 2 AND sep * 10 >= n * 6', "'pure'"), (rlike('x', Q.BORDER) + ' AND sep >= 3', "'border'"), (rlike('x', Q.SPACED) + ' AND sep >= 3 AND n >= 5', "'spaced'"), (rlike('x', Q.JUNCTION) + " AND contains(x, '+') AND sep >= 3", "'junction'"), (rlike('x', _DASH), "'simple_dash'"))} AS kind,
  {rlike('x', Q.NESTED_HEADER)} AND {rlike("coalesce(nxt, '')", Q.DATA)} AS nested FROM m),
f AS (SELECT *, kind IS NULL AND pipes >= 3 AS pipe_data, kind IS NULL AND {rlike('x', Q.SPACE_COLUMNS)} AS space_columns,
  CASE WHEN kind IS NULL THEN CAST(pipes >= 2 AS INT) + CAST({rlike('x', Q.SPACE_COLUMNS)} AS INT) ELSE 0 END AS tab,
  CASE WHEN kind IS NULL THEN CAST(len(ws) <= 4 AND {rlike('x', Q.DATA)} AS INT) + CAST(len(ws) >= 2 AND len(list_filter(ws, lambda w: {rlike('w', '^[' + chr(92) + 'p{L}]{3,}' + chr(92) + 'z')})) > 0 AND len(list_filter(ws, lambda w: {rlike('w', Q.DATA)})) > 0 AS INT) + CAST({rlike('x', Q.ROW_START)} AS INT) ELSE 0 END AS fig FROM k),
a AS (SELECT doc_id, count(*) AS n_lines, sum(CAST(nested AS INT)) AS nested, count(kind) AS sep, sum(tab) AS tab, sum(fig) AS fig, {', '.join(f"count(*) FILTER (WHERE {'kind = ' + q(t) if t in Q.KINDS else t}) AS t_{t}" for t in Q.TYPES)} FROM f GROUP BY doc_id),
b AS (SELECT *, concat_ws(', ', {', '.join(f"CASE WHEN t_{t} > 0 THEN '{t}:' || t_{t} END" for t in Q.TYPES)}) AS types FROM a),
tbl AS (SELECT doc_id, {case(('nested >= 1', '10'), ('sep >= 2', '8'), ('sep >= 1 AND tab >= 1', '6'), ('sep >= 1 AND n_lines >= 3', '5'), ('fig >= 5', '5'), ('tab >= 3', '4'), ('fig >= 3', '3'), otherwise='0')} AS table_tenths,
  {case(('nested >= 1', "'nested_table_headers_detected(' || nested || ' instances)'"), ('sep >= 2', "'table_patterns_detected(' || sep || ' separators: ' || types || ')'"), ('sep >= 1 AND tab >= 1', "'table_structure_detected(' || sep || ' separators, ' || tab || ' pipe lines)'"), ('sep >= 1 AND n_lines >= 3', "'single_separator_table(' || sep || ' separator, ' || n_lines || ' total lines: ' || types || ')'"), ('fig >= 5', "'ocr_table_patterns(' || fig || ' structured data lines)'"), ('tab >= 3', "'pipe_table_detected(' || tab || ' pipe-separated lines)'"), ('fig >= 3', "'structured_data_detected(' || fig || ' data patterns)'"))} AS table_issue FROM b),
w AS (SELECT doc_id, text, {sql_words('text')} AS ws, list_transform({sql_words('text')}, lambda x: regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}_]', '', 'g')) AS clean FROM docs_aug),
ms AS (SELECT doc_id, text, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(text) AS BIGINT) AS n_chars_text, CAST(len({lines('text')}) AS BIGINT) AS n_lines, CAST({among('text', ' ')} AS BIGINT) AS n_spaces,
  CASE WHEN length(replace(replace(text, ' ', ''), chr(10), '')) > 0 THEN CAST({among('text', ' ')} AS DOUBLE) / length(replace(replace(text, ' ', ''), chr(10), '')) ELSE 0.0 END AS spacing,
  CAST(len(list_filter(clean, lambda x: length(x) >= 3 AND ({' OR '.join([*[f"starts_with(x, '{p}')" for p in Q.REVERSED_PREFIXES], *[f"ends_with(x, '{p}')" for p in Q.REVERSED_SUFFIXES], 'x IN (' + ', '.join(q(v) for v in Q.REVERSED_WORDS) + ')'])}))) AS BIGINT) AS n_reversed,
  CAST(len(list_filter(ws, lambda x: regexp_matches(x, '^\\p{{L}}\\z'))) AS BIGINT) AS n_single, CAST({count('text', Q.ODD_CHARACTER)} AS BIGINT) AS n_odd, CAST({count('text', Q.MONEY)} AS BIGINT) AS n_money, CAST({count('text', Q.MARKS)} AS BIGINT) AS n_marks,
  CAST(len(list_filter({lines('text')}, lambda x: length({strip('x')}) > 20)) AS BIGINT) AS n_substantial FROM w),
sc AS (SELECT ms.*, coalesce(table_tenths, 0) AS table_tenths, table_issue,
  CASE WHEN spacing > 0.5 THEN 2 ELSE 0 END AS spacing_tenths, CASE WHEN n_words > 0 AND n_reversed * 20 > n_words THEN 6 ELSE 0 END AS reversed_tenths, CASE WHEN n_words > 0 AND n_single * 10 > n_words THEN 2 ELSE 0 END AS single_tenths,
  CASE WHEN n_odd * 100 > n_chars_text THEN 4 ELSE 0 END AS encoding_tenths, CASE WHEN n_money > 0 THEN 2 ELSE 0 END AS financial_tenths, CASE WHEN n_marks > 0 THEN 5 ELSE 0 END AS symbols_tenths, CASE WHEN n_substantial < 2 THEN 4 ELSE 0 END AS sparsity_tenths
  FROM ms LEFT JOIN tbl USING (doc_id)),
tot AS (SELECT *, {' + '.join(f'{s}_tenths' for s in Q.SCORES)} AS total_tenths,
  concat_ws('; ', table_issue, CASE WHEN spacing_tenths > 0 THEN 'character_spacing_corruption(ratio:' || format('{{:.2f}}', spacing) || ')' END, CASE WHEN reversed_tenths > 0 THEN 'reversed_words(' || n_reversed || '/' || n_words || ')' END, CASE WHEN single_tenths > 0 THEN 'single_char_words(' || n_single || ')' END, CASE WHEN encoding_tenths > 0 THEN 'encoding_issues(' || n_odd || ')' END,
    CASE WHEN financial_tenths > 0 THEN 'financial_corruption(' || n_money || ')' END, CASE WHEN symbols_tenths > 0 THEN 'checkmark_symbols(' || n_marks || ')' END, CASE WHEN sparsity_tenths > 0 THEN 'sparse_content(substantial_lines:' || n_substantial || ')' END) AS issues FROM sc)"""

QUERIES, ORACLES = {}, {}


def _add(name, build, sql):
    QUERIES[name], ORACLES[name] = build, sql


_add("text_metrics", lambda s, d: Q.with_measures(docs_aug(s, d)).select("doc_id", "n_words", "n_chars_text", "n_lines", "n_spaces"), f"WITH {_facts} SELECT doc_id, n_words, n_chars_text, n_lines, n_spaces FROM ms")
_SINGLE = {"spacing": "spacing", "reversed": "n_reversed", "single": "n_single", "encoding": "n_odd", "financial": "n_money", "symbols": "n_marks", "sparsity": "n_substantial"}
for _key, _score in {"score_spacing": "spacing", "score_reversed": "reversed", "score_single_chars": "single", "score_encoding": "encoding", "score_financial": "financial", "score_symbols": "symbols", "score_sparsity": "sparsity"}.items():
    _m = _SINGLE[_score]
    _add(_key, lambda s, d, m=_m, k=_score: Q.with_scores(docs_aug(s, d)).select("doc_id", F.col(m).alias("measure"), (F.col(f"{k}_tenths") / 10).alias("score")), f"WITH {_facts} SELECT doc_id, {_m} AS measure, {_score}_tenths / 10.0::DOUBLE AS score FROM sc")
_add("score_table_patterns", lambda s, d: Q.with_table_score(docs_aug(s, d)).select("doc_id", (F.col("table_tenths") / 10).alias("score"), F.coalesce("table_issue", F.lit("")).alias("issue")), f"WITH {_facts} SELECT doc_id, table_tenths / 10.0::DOUBLE AS score, coalesce(table_issue, '') AS issue FROM sc")
_add("corruption_score", lambda s, d: Q.corruption_score(docs_aug(s, d)).select("doc_id", *[f"{x}_score" for x in (*Q.SCORES, "total")], "issues"), f"WITH {_facts} SELECT doc_id, {', '.join(f'{x}_tenths / 10.0::DOUBLE AS {x}_score' for x in (*Q.SCORES, 'total'))}, issues FROM tot")
_reason = "CASE WHEN total_tenths >= 1 AND issues <> '' THEN issues ELSE 'clean_text(score:' || format('{:.2f}', total_tenths / 10.0::DOUBLE) || ')' END"
_add("vision_decision", lambda s, d: Q.vision_decision(docs_aug(s, d)).select("doc_id", "use_vision", "reason", "total_score"), f"WITH {_facts} SELECT doc_id, total_tenths >= 1 AS use_vision, {_reason} AS reason, total_tenths / 10.0::DOUBLE AS total_score FROM tot")
_add("fallback_gate", lambda s, d: Q.fallback_gate(docs_aug(s, d)).select("doc_id", "gate"), f"WITH {_facts} SELECT doc_id, CASE WHEN total_tenths <= 1 AND table_tenths = 0 THEN 'text' ELSE 'escalate' END AS gate FROM tot")
_has = lambda *m: "(" + " OR ".join(f"contains(lower(text), {q(x)})" for x in m) + ")"
_add("extraction_strategy", lambda s, d: Q.extraction_strategy(docs_aug(s, d)).select("doc_id", "strategy"), f"WITH {_facts} SELECT doc_id, {case(('table_tenths > 3', q('table_focused')), (_has('form', 'checkbox', '☐', '☑', 'x'), q('form_focused')), (_has('def ', 'class ', 'import ', '$'), q('technical_doc')), otherwise=q('standard'))} AS strategy FROM sc")
