"""Queries on content profiles, chunks, confidences and cleaning, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import text_of
from ..operators import clean as C
from ..operators import profile as P
from ..operators import routing as R
from ..sources import derived as D
from .sql import DOCS, PAGES, S, case, count, lines, q, rlike, strip
from .sql import words as sql_words

QUERIES, ORACLES = {}, {}


def _add(name, build, sql):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


_any = lambda x, ps: "(" + " OR ".join(rlike(x, p) for p in ps) + ")"
_profile = lambda source: f"""pr AS (SELECT *, {rlike('text', R.TABLE_CHARS)} OR {count('text', P.GAPS)} > 5 AS has_tables, {_any('text', P.PROFILE_CHECKBOXES)} AS has_checkboxes, {rlike('text', P.BULLETS)} OR {rlike('text', P.NUMBERED)} AS has_lists, {_any('text', P.TECHNICAL)} AS has_technical,
 {count('text', P.HEADERS)} AS hd, CAST(len({lines('text')}) AS BIGINT) AS line_count, CAST(len({sql_words('text')}) AS BIGINT) AS word_count FROM {source}), prf AS (SELECT *, CASE WHEN hd > 5 THEN 'complex' WHEN hd > 2 THEN 'moderate' ELSE 'simple' END AS complexity, CAST(greatest(1, hd) AS BIGINT) AS sections FROM pr)"""  # noqa: E731
_cols = ["has_tables", "has_checkboxes", "has_lists", "has_technical", "complexity", "sections", "line_count", "word_count"]
_add("content_profile", lambda s, d: P.content_profile(D.doc_pages(s, d)).select("doc_id", "page_no", *_cols), f"WITH {PAGES}, {_profile('doc_pages')} SELECT doc_id, page_no, {', '.join(_cols)} FROM prf")
_strategy = case(("has_checkboxes AND has_tables", "'comprehensive'"), ("has_checkboxes", "'form_focused'"), ("has_tables", "'table_focused'"), ("has_technical", "'technical'"), ("complexity = 'complex'", "'structure_focused'"), otherwise="'standard'")
_add("page_strategy", lambda s, d: P.page_strategy(P.content_profile(D.doc_pages(s, d))).select("doc_id", "page_no", "strategy", "handler"), f"WITH {PAGES}, {_profile('doc_pages')}, st AS (SELECT doc_id, page_no, {_strategy} AS strategy FROM prf) SELECT *, CASE WHEN strategy = 'structure_focused' THEN 'standard' ELSE strategy END AS handler FROM st")
_structure = f"""WITH {PAGES}, f AS (SELECT doc_id, CAST({rlike('text', P.DOCUMENT_CHARS)} OR {count('text', R.ALIGNED)} > 3 AS BIGINT) AS tb, CAST({_any('text', R.CHECKBOXES)} AS BIGINT) AS fm, {count('text', P.HEADERS)} AS hd FROM doc_pages),
g AS (SELECT doc_id, count(*) AS total_pages, CAST(sum(tb) AS BIGINT) AS table_pages, CAST(sum(fm) AS BIGINT) AS form_pages, CAST(sum(hd) AS BIGINT) AS headers FROM f GROUP BY doc_id),
h AS (SELECT *, concat_ws(',', CASE WHEN table_pages * 10 > total_pages * 3 THEN 'tables_throughout' END, CASE WHEN form_pages > 0 THEN 'form_elements' END) AS elements, concat_ws(',', CASE WHEN table_pages * 10 > total_pages * 3 THEN 'consistent_table_formatting' END, CASE WHEN form_pages > 0 THEN 'checkbox_standardization' END) AS challenges, CASE WHEN headers > 2 * total_pages THEN 'complex' WHEN headers > total_pages THEN 'moderate' ELSE 'simple' END AS structure FROM g)"""
_add("doc_structure", lambda s, d: P.document_structure(D.doc_pages(s, d)).drop("strategy"), f"{_structure} SELECT * FROM h")
_add("doc_strategy", lambda s, d: P.document_structure(D.doc_pages(s, d)).select("doc_id", "strategy"), f"{_structure} SELECT doc_id, CASE WHEN table_pages > 0 AND form_pages > 0 THEN 'comprehensive_document' WHEN table_pages * 10 > total_pages * 3 THEN 'table_heavy_document' WHEN form_pages > 0 THEN 'form_document' WHEN structure = 'complex' THEN 'structured_document' ELSE 'standard_document' END AS strategy FROM h")
_nn = "chr(10) || chr(10)"
_asm = lambda sep: f"SELECT doc_id, string_agg(text, {sep} ORDER BY page_no) AS text, count(*) AS pages FROM doc_pages GROUP BY doc_id"
_add("assemble_doc", lambda s, d: P.assemble(D.doc_pages(s, d)), f"WITH {PAGES} {_asm(_nn + ' || ' + q('---PAGE BREAK---') + ' || ' + _nn)}")
_add("assemble_blocks", lambda s, d: P.assemble_blocks(D.doc_pages(s, d), budget=8192), f"""WITH {PAGES}, t AS (SELECT doc_id, page_no, CASE WHEN page_no > 1 THEN {_nn} || '---PAGE BREAK---' || {_nn} ELSE '' END || text AS t FROM doc_pages), st AS (SELECT *, CAST(sum(strlen(t)) OVER (PARTITION BY doc_id ORDER BY page_no) - strlen(t) AS BIGINT) AS s FROM t),
i AS (SELECT doc_id, t, s, unnest(range(0, greatest(1, CAST(ceil(length(t) / 1024.0) AS BIGINT)))) AS i FROM st), p AS (SELECT doc_id, s + strlen(substr(t, 1, i * 1024)) AS s, substr(t, i * 1024 + 1, 1024) AS t FROM i)
SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE s // 4096 END AS block, CAST(min(s) AS BIGINT) AS start, coalesce(string_agg(t, '' ORDER BY s) FILTER (WHERE t <> ''), '') AS text FROM p GROUP BY 1, 2""")
_add("simple_docs", lambda s, d: P.simple_documents(D.doc_pages(s, d)).select("doc_id", "pages", "is_simple", "confidence", F.coalesce(F.md5("text"), F.lit("")).alias("digest")), f"""WITH {PAGES}, a AS ({_asm(_nn)}), b AS (SELECT *, pages > 3 AND NOT {rlike('text', P.FAST_CHARS)} AND NOT {rlike('text', P.FAST_CHECKS)} AND {count('text', R.ALIGNED)} <= pages * 3 AND {count('text', P.HEADERS)} <= pages * 2 AND {count('text', P.BULLETS)} + {count('text', P.NUMBERED)} <= pages * 3 AS is_simple FROM a)
SELECT doc_id, pages, is_simple, CASE WHEN is_simple THEN 0.9 END::DOUBLE AS confidence, CASE WHEN is_simple THEN md5(text) ELSE '' END AS digest FROM b""")
_chunks = f"""{PAGES}, cm AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS n, count(*) OVER (PARTITION BY doc_id) AS np, sum(length(text)) OVER (PARTITION BY doc_id) AS nc FROM doc_pages),
ck AS (SELECT doc_id, CASE WHEN np > 5 OR nc > 50000 THEN n // 3 ELSE 0 END AS chunk_no, min(page_no) AS first_page, max(page_no) AS last_page, string_agg(text, {_nn} || '---PAGE BREAK---' || {_nn} ORDER BY page_no) AS text FROM cm GROUP BY ALL)"""
_chunks = _chunks.replace("GROUP BY ALL", "GROUP BY doc_id, CASE WHEN np > 5 OR nc > 50000 THEN n // 3 ELSE 0 END")
_add("chunk_plan", lambda s, d: P.chunk_plan(D.doc_pages(s, d)), f"WITH {_chunks} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, first_page, last_page, text FROM ck")
_add("request_table", lambda s, d: P.request_table(P.chunk_plan(D.doc_pages(s, d)), 1000), f"WITH {_chunks} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, 'You format documents for retrieval.' AS system, 'Format pages ' || first_page || '-' || last_page || ' as Markdown:' || {_nn} || substr(text, 1, 1000) AS user, length(text) > 1000 AS truncated FROM ck")


def _responses(chunks):
    return chunks.select("doc_id", "chunk_no", F.upper("text").alias("content"), F.length("text").cast("long").alias("tokens"), ((F.col("doc_id") + F.col("chunk_no")) % 5 != 0).alias("success"))


_add("response_merge", lambda s, d: P.merge_responses(c := P.chunk_plan(D.doc_pages(s, d)), _responses(c)).select("doc_id", "tokens", "fallbacks"), f"""WITH {_chunks}, m AS (SELECT doc_id, chunk_no, (doc_id + chunk_no) % 5 <> 0 AS ok, text FROM ck), j AS (SELECT doc_id, string_agg(CASE WHEN ok THEN upper(text) ELSE text END, {_nn} ORDER BY chunk_no) AS text, CAST(sum(CASE WHEN ok THEN length(text) ELSE 0 END) AS BIGINT) AS tokens, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS fallbacks FROM m GROUP BY doc_id)
SELECT doc_id, tokens, fallbacks FROM j""")

_half = "substr(text, 1, CAST(length(text) // 3 AS BIGINT))"
_rich = "'## Title' || chr(10) || chr(10) || '### Part' || chr(10) || chr(10) || '**A** - **B**: c' || chr(10) || 'mark *[SELECTED]*' || chr(10) || text"
_twice = "text || chr(10) || text || chr(10) || '# Loose [x]' || repeat('| a | b |' || chr(10), 12) || repeat('**A** - **B**: c' || chr(10), CAST(doc_id % 24 AS BIGINT))"
_fmt = f"CASE doc_id % 4 WHEN 0 THEN {_half} WHEN 1 THEN {_rich} WHEN 2 THEN {_twice} ELSE text END AS formatted"


def _formatted(df):
    return df.selectExpr("*", "CASE doc_id % 4 WHEN 0 THEN substr(text, 1, length(text) div 3) WHEN 1 THEN concat('## Title\\n\\n### Part\\n\\n**A** - **B**: c\\nmark *[SELECTED]*\\n', text) WHEN 2 THEN concat(text, '\\n', text, '\\n# Loose [x]', repeat('| a | b |\\n', 12), repeat('**A** - **B**: c\\n', cast(doc_id % 24 as int))) ELSE text END AS formatted")


def _clamp(base, *rules):
    return f"greatest(0, least(100, {base} + {' + '.join(f'CASE WHEN {r} THEN {n} ELSE 0 END' for r, n in rules)})) / 100.0::DOUBLE"


_n, _m = "length(text)", "length(formatted)"
_fc = _clamp(85, (f"{_n} > 0 AND {_m} * 2 < {_n}", -30), (f"{_n} > 0 AND {_m} > {_n} * 2", -20), (f"{_n} = 0 OR ({_m} * 10 >= {_n} * 8 AND {_m} * 10 <= {_n} * 12)", 5), (f"sections > 1 AND {rlike('formatted', '(?m)^#{2,3}' + S)}", 5), ("has_tables AND contains(formatted, '**')", 5), ("has_checkboxes AND contains(formatted, '[SELECTED]')", 5), (f"len({lines('formatted')}) * 2 > len({lines('text')})", 5))
_add("format_confidence", lambda s, d: P.page_confidence(P.content_profile(_formatted(D.doc_pages(s, d)))).select("doc_id", "page_no", "format_confidence"), f"WITH {PAGES}, fm AS (SELECT *, {_fmt} FROM doc_pages), {_profile('fm')} SELECT doc_id, page_no, {_fc} AS format_confidence FROM prf")
_dc = _clamp(80, (f"{rlike('formatted', '(?m)^## ')} AND {rlike('formatted', '(?m)^### ')}", 5), (f"has_tables AND {rlike('formatted', P.FLATTENED)}", 10), (f"has_tables AND NOT {rlike('formatted', P.FLATTENED)}", -20), (f"has_forms AND {rlike('formatted', chr(92) + '[SELECTED' + chr(92) + ']|' + chr(92) + '[ ' + chr(92) + ']')}", 5), (f"{_n} > 0 AND {_m} * 10 >= {_n} * 7 AND {_m} * 10 <= {_n} * 13", 5), (f"{_n} > 0 AND {_m} * 2 < {_n}", -20))
_add("doc_confidence", lambda s, d: P.document_confidence(_formatted(D.docs_aug(s, d)).withColumn("has_tables", text_of().contains("|")).withColumn("has_forms", text_of().contains("["))).select("doc_id", "doc_confidence"), f"WITH {DOCS}, fm AS (SELECT *, {_fmt}, contains(text, '|') AS has_tables, contains(text, '[') AS has_forms FROM docs_aug) SELECT doc_id, {_dc} AS doc_confidence FROM fm")
_sel = chr(92) + "[SELECTED" + chr(92) + "]|" + chr(92) + "[ " + chr(92) + "]"
_add("consistency_score", lambda s, d: P.consistency_score(_formatted(D.docs_aug(s, d))).select("doc_id", "consistency"), f"WITH {DOCS}, fm AS (SELECT *, {_fmt} FROM docs_aug) SELECT doc_id, (CAST(len(list_filter({lines('formatted')}, lambda x: starts_with(x, '#') AND NOT regexp_matches(x, '^#{{2,4}} '))) = 0 AS INT) + CAST(NOT contains(formatted, '**') OR {rlike('formatted', P.FLATTENED)} AS INT) + CAST(NOT {rlike('formatted', _sel)} OR NOT {rlike('formatted', P.RAW_MARKS)} AS INT)) / 3.0::DOUBLE AS consistency FROM fm")


def _extractions(s, d):
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("doc_id") % len(v) + 1).cast("int"))
    return D.docs_aug(s, d).withColumn("width", pick(800, 200, 2000, 50, 3000)).withColumn("height", pick(600, 150, 1500, 50, 3000)).withColumn("retries", (F.col("doc_id") % 4).cast("int")).withColumn("strategy", pick("standard", "table_focused", "form_focused"))


_add("ocr_confidence", lambda s, d: P.extraction_confidence(_extractions(s, d)).select("doc_id", "ocr_confidence", "base_confidence"), f"""WITH {DOCS}, e AS (SELECT *, [800, 200, 2000, 50, 3000][CAST(doc_id % 5 AS INT) + 1] * [600, 150, 1500, 50, 3000][CAST(doc_id % 5 AS INT) + 1] AS px, doc_id % 4 AS r, ['standard', 'table_focused', 'form_focused'][CAST(doc_id % 3 AS INT) + 1] AS st FROM docs_aug)
SELECT doc_id, {_clamp('85 - r * 15', ('length(text) < 10', -40), ('length(text) > 1000', 5), ('px < 100000', -20), ('px > 1000000', 10), ("st = 'table_focused' AND contains(lower(text), 'table')", 5), ("st = 'form_focused' AND (contains(text, '[') OR contains(text, '☑') OR contains(text, '☐'))", 5))} AS ocr_confidence, {_clamp('80 - r * 10', ('length(text) < 10', -30), ('length(text) > 1000', 10))} AS base_confidence FROM e""")
_pipe = "[|][^|]+[|]"
_add("table_format", lambda s, d: P.table_format(_formatted(D.docs_aug(s, d))).select("doc_id", "table_format"), f"WITH {DOCS}, fm AS (SELECT *, {_fmt} FROM docs_aug) SELECT doc_id, CASE WHEN {count('formatted', P.FLATTENED)} > 10 THEN 'flattened' WHEN {count('formatted', _pipe)} > 10 THEN 'pipe' ELSE 'none' END AS table_format FROM fm")

# ---- cleaning


def _without(patterns):
    out = "text"
    for _, p in patterns:
        out = f"regexp_replace({out}, {q(p)}, '', 'g')"
    return out


def _finds(patterns):
    return " || ".join(f"list_transform(regexp_extract_all(text, {q(p)}), lambda m: {q(k + ': ' + chr(39))} || {strip('m')} || '''')" for k, p in patterns)


_tidy = lambda x: strip(f"regexp_replace(regexp_replace({x}, {q(chr(92) + 'n' + S + '*' + chr(92) + 'n' + S + '*' + chr(92) + 'n')}, chr(10) || chr(10), 'g'), {q('^' + S + '*' + chr(92) + 'n')}, '')")
_found = _finds(C.COMMENTARY)
for _key, _patterns in (("clean_ai_text", C.COMMENTARY), ("clean_extracted_text", C.EXTRACTION_COMMENTARY)):
    _add(_key, lambda s, d, p=_patterns: C.clean_commentary(D.docs_aug(s, d), patterns=p).select("doc_id", "cleaned", F.array_join("removed", " / ").alias("removed")), f"WITH {DOCS} SELECT doc_id, {_tidy(_without(_patterns))} AS cleaned, array_to_string({_finds(_patterns)}, ' / ') AS removed FROM docs_aug")
_x = strip("x")
_empty = f"{rlike(_x, C.PLACEHOLDER)} AND ({rlike(_x, C.EMPTY_SHAPES[0])} OR {rlike(_x, C.EMPTY_SHAPES[1])})"
_kept = f"list_filter({lines('text')}, lambda x: NOT ({_empty}))"
_blank_run = chr(92) + "n" + S + "*" + chr(92) + "n" + S + "*" + chr(92) + "n+"
_stripped = strip(f"regexp_replace(array_to_string({_kept}, chr(10)), {q(_blank_run)}, chr(10) || chr(10), 'g')")
_add("strip_placeholders", lambda s, d: C.strip_placeholders(D.docs_aug(s, d)).select("doc_id", "stripped", "n_dropped"), f"WITH {DOCS} SELECT doc_id, {_stripped} AS stripped, CAST(len({lines('text')}) - len({_kept}) AS BIGINT) AS n_dropped FROM docs_aug")
_RULE = rf"^\|?{S}*:?--+{S}*(\|{S}*:?--+{S}*)+\|?$"
_SEPARATOR = rf"^\|?{S}*[-:]+{S}*(\|{S}*[-:]+{S}*)*\|?$"
_row = f"(NOT starts_with({strip('line')}, '```') AND length(line) - length(replace(line, '|', '')) >= 2 AND ({rlike(strip('line'), C.PIPE_ROW)} OR {rlike(strip('line'), _RULE)}))"
_tl = f"""WITH {DOCS}, tl AS (SELECT doc_id, unnest({lines('text')}) AS line, generate_subscripts({lines('text')}, 1) - 1 AS i FROM docs_aug WHERE contains(text, '|')), tr AS (SELECT *, {_row} AS isrow FROM tl),
tb AS (SELECT *, CASE WHEN isrow THEN i - row_number() OVER (PARTITION BY doc_id, isrow ORDER BY i) END AS block FROM tr), tz AS (SELECT *, CASE WHEN isrow THEN count(*) OVER (PARTITION BY doc_id, isrow, block) END AS size FROM tb)"""
_add("table_blocks", lambda s, d: C.table_blocks(D.docs_aug(s, d)), f"{_tl} SELECT doc_id, min(i) AS first_line, max(i) AS last_line, max(size) AS size FROM tz WHERE block IS NOT NULL GROUP BY doc_id, block")
_parts = f"list_transform(string_split({strip('line')}, '|'), lambda c: {strip('c')})"
_bold = "regexp_replace({0}, '\\*\\*(.*?)\\*\\*', '\\1', 'g')"
_edge = "CASE WHEN len({0}) > 0 AND {0}[len({0})] = '' THEN {0}[1:len({0}) - 1] ELSE {0} END"
_flat = f"""{_tl}, c1 AS (SELECT *, CASE WHEN p[1] = '' THEN p[2:] ELSE p END AS p1, row_number() OVER (PARTITION BY doc_id, block ORDER BY i) AS n FROM (SELECT *, {_parts} AS p FROM tz)), c2 AS (SELECT *, {_edge.format('p1')} AS c FROM c1),
c3 AS (SELECT *, list_transform(list_filter(first_value(c) OVER (PARTITION BY doc_id, block ORDER BY i), lambda v: v <> ''), lambda v: {_bold.format('v')}) AS h, CASE WHEN c[1] = '' THEN c[2:] ELSE c END AS d FROM c2),
c4 AS (SELECT *, CASE WHEN block IS NOT NULL AND size >= 2 AND (n > 2 OR (n = 2 AND NOT {rlike(strip('line'), _SEPARATOR)})) THEN list_filter(list_transform(range(2, len(d) + 1), lambda j: CASE WHEN j <= len(h) AND d[j] <> '' THEN '**' || h[j] || '**' || CASE WHEN d[1] <> '' THEN ' - **' || {_bold.format('d[1]')} || '**' ELSE '' END || ': ' || {_bold.format('d[j]')} END), lambda e: e IS NOT NULL) ELSE CAST([] AS VARCHAR[]) END AS e FROM c3),
c5 AS (SELECT *, sum(len(e)) OVER (PARTITION BY doc_id, block) AS given FROM c4), c6 AS (SELECT doc_id, i, CASE WHEN block IS NOT NULL AND size >= 2 AND given > 0 THEN e ELSE [line] END AS o FROM c5)
SELECT doc_id, array_to_string(flatten(list(o ORDER BY i)), chr(10)) AS text FROM c6 GROUP BY doc_id UNION ALL SELECT doc_id, text FROM docs_aug WHERE NOT contains(text, '|')"""


def _gapped(s, d):
    """Every third document with the first closed cell of its first table emptied."""
    return D.docs_aug(s, d).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"(?s)\A(.*?)\|[^|\n]*\|", "$1| |")).otherwise(F.col("text")))


_add("flatten_tables", lambda s, d: C.flatten_tables(D.docs_aug(s, d)), _flat)
# cells that keep their columns: whole rows, and names that may be empty
_kept = _flat.replace("list_transform(list_filter(first_value(c) OVER (PARTITION BY doc_id, block ORDER BY i), lambda v: v <> ''), lambda v:", "list_transform(first_value(c) OVER (PARTITION BY doc_id, block ORDER BY i), lambda v:").replace("CASE WHEN c[1] = '' THEN c[2:] ELSE c END AS d", "c AS d")
_kept = _kept.replace("'**' || h[j] || '**' || CASE WHEN d[1] <> '' THEN ' - **' ||", "CASE WHEN h[j] <> '' THEN '**' || h[j] || '**' ELSE '' END || CASE WHEN d[1] <> '' THEN CASE WHEN h[j] <> '' THEN ' - ' ELSE '' END || '**' ||").replace("ELSE '' END || ': ' ||", "ELSE '' END || CASE WHEN h[j] <> '' OR d[1] <> '' THEN ': ' ELSE '' END ||")
_add("flatten_tables_by_position", lambda s, d: C.flatten_tables(_gapped(s, d), "position"), _kept.replace("docs_aug WHERE contains(text, '|')", "gapped WHERE contains(text, '|')").replace("docs_aug WHERE NOT", "gapped WHERE NOT").replace("tl AS (", "gapped AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN regexp_replace(text, '\\|[^|\\n]*\\|', '| |') ELSE text END AS text FROM docs_aug), tl AS (", 1))
_ck1, _ck2 = rf"(?m)^({S}*)(?:\[[xX✓✔]\]|[☑✓✔]){S}*(.*?){S}*$", rf"(?m)^({S}*)(?:\[ \]|☐){S}*"
_add("normalize_checkboxes", lambda s, d: C.normalise_checkboxes(D.docs_aug(s, d)).select("doc_id", "marked"), f"WITH {DOCS} SELECT doc_id, regexp_replace(regexp_replace(text, {q(_ck1)}, '\\1\\2 *[SELECTED]*', 'g'), {q(_ck2)}, '\\1', 'g') AS marked FROM docs_aug")
_rep = f"WITH {PAGES}, c AS (SELECT doc_id, page_no, {_found} AS removed FROM doc_pages), x AS (SELECT doc_id, split_part(unnest(removed), ':', 1) AS type FROM c), y AS (SELECT doc_id, type, count(*) AS n FROM x GROUP BY ALL)"
_rep = _rep.replace("GROUP BY ALL", "GROUP BY doc_id, type")
_add("cleaning_report", lambda s, d: C.cleaning_report(C.clean_commentary(D.doc_pages(s, d))), f"{_rep}, p AS (SELECT doc_id, count(*) AS pages, CAST(sum(CAST(len(removed) > 0 AS INT)) AS BIGINT) AS pages_cleaned, CAST(sum(len(removed)) AS BIGINT) AS fragments FROM c GROUP BY doc_id), t AS (SELECT doc_id, string_agg(type || '=' || n, ', ' ORDER BY n DESC, type) AS types FROM y GROUP BY doc_id) SELECT p.*, pages_cleaned * 100 / CAST(pages AS DOUBLE) AS rate, coalesce(types, '') AS types FROM p LEFT JOIN t USING (doc_id)")
_stats = f"{_rep}, p AS (SELECT doc_id, count(*) AS pages, sum(CAST(len(removed) > 0 AS INT)) AS pc, sum(len(removed)) AS fr, string_agg('### Page ' || page_no || ' (' || len(removed) || ' fragment' || CASE WHEN len(removed) = 1 THEN '' ELSE 's' END || ')' || chr(10) || array_to_string(list_transform(removed, lambda x: '- ' || x), chr(10)), chr(10) || chr(10) ORDER BY page_no) FILTER (WHERE len(removed) > 0) AS bp FROM c GROUP BY doc_id), t AS (SELECT doc_id, string_agg('- ' || type || ': ' || n, chr(10) ORDER BY n DESC, type) AS types FROM y GROUP BY doc_id), z AS (SELECT *, format('{{:.1f}}', pc * 100 / CAST(pages AS DOUBLE)) AS rate FROM p LEFT JOIN t USING (doc_id))"
_add("cleaning_report_text", lambda s, d: C.cleaning_report_text(C.clean_commentary(D.doc_pages(s, d))), f"{_stats} SELECT doc_id, '# Cleaning report' || chr(10) || chr(10) || '- Pages: ' || pages || chr(10) || '- Cleaned pages: ' || pc || chr(10) || '- Fragments: ' || fr || chr(10) || '- Rate: ' || rate || '%' || chr(10) || chr(10) || CASE WHEN fr > 0 THEN '## Types' || chr(10) || chr(10) || types || chr(10) || chr(10) || '## Pages' || chr(10) || chr(10) || bp ELSE 'Nothing was removed.' END AS report, CASE WHEN fr > 0 THEN 'Removed ' || fr || ' fragment' || CASE WHEN fr = 1 THEN '' ELSE 's' END || ' from ' || pc || '/' || pages || ' pages (' || rate || '%)' ELSE 'Nothing was removed' END AS summary FROM z")
_add("top_fragment_types", lambda s, d: C.top_fragment_types(C.clean_commentary(D.doc_pages(s, d))), f"{_rep}, z AS (SELECT type, CAST(sum(n) AS BIGINT) AS n FROM y GROUP BY type) SELECT type, n, row_number() OVER (ORDER BY n DESC, type) AS rank FROM z ORDER BY n DESC, type LIMIT 3")
# citations look ahead, which SQL's regular expressions cannot; golden rows hold these two
# RE2 looks neither back nor ahead: what may follow a number is taken with it and left out of the group
_own_line = "(?:[" + C.SUPERSCRIPTS + r"]+|\[\p{Nd}+\]|\(\p{Nd}+\)|\p{Nd}+(?:\s|$|[.,;:]))"
_cites = [("[" + C.SUPERSCRIPTS + "]+", 0), (r"\[\p{Nd}+\]", 0), (r"\(\p{Nd}+\)", 0), (r"(\p{Nd}+)(?:\s|$|[.,;:])", 1)]
_ascii = lambda x: f"translate(regexp_replace({x}, {q(chr(92) + '[|' + chr(92) + ']|[()]')}, '', 'g'), {q(C.SUPERSCRIPTS)}, {q(C.DIGITS)})"
_fl, _found = q(C.FOOTNOTE_LINE), "list_concat(" + ", ".join(f"regexp_extract_all(x, {q(p)}, {g})" for p, g in _cites) + ")"


def _noted(cut):
    """Citations and footnote lines in the order of the text, each marker once, and a fold of replacements, longest marker first."""
    return f"""WITH {DOCS}, a AS (SELECT doc_id, text, list_transform({lines('text')}, lambda x: {strip('x')}) AS own FROM docs_aug),
b AS (SELECT doc_id, text, list_filter(own, lambda x: regexp_matches(x, {_fl})) AS nl, list_filter(own, lambda x: NOT regexp_matches(x, {q('^' + _own_line)})) AS body FROM a),
c AS (SELECT doc_id, text, list_transform(nl, lambda x: {_ascii(f'regexp_extract(x, {_fl}, 1)')}) AS nk, list_transform(nl, lambda x: {strip(f'regexp_extract(x, {_fl}, 2)')}) AS nt, CASE WHEN len(nl) > 0 THEN flatten(list_transform(body, lambda x: {_found})) ELSE [] END AS ct FROM b),
d AS (SELECT doc_id, text, nk, nt, unnest(ct) AS f, generate_subscripts(ct, 1) AS i FROM c), e AS (SELECT doc_id, f, any_value({_ascii('f')}) AS k, min(i) AS i, any_value(nt[list_position(nk, {_ascii('f')})]) AS note FROM d GROUP BY doc_id, f),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS n FROM e WHERE note <> ''),
h AS (SELECT doc_id, list({{'t': '', 'f': f, 's': ' (' || {cut} || ')'}} ORDER BY length(f) DESC, i) AS ns, list(k) AS ks FROM g WHERE n = 1 GROUP BY doc_id),
r AS (SELECT doc_id, text, ns, array_to_string(list_transform({lines('text')}, lambda x: CASE WHEN regexp_matches(x, {_fl}) AND list_contains(ks, {_ascii(f'regexp_extract(x, {_fl}, 1)')}) THEN '' ELSE x END), chr(10)) AS gone FROM docs_aug LEFT JOIN h USING (doc_id)),
z AS (SELECT doc_id, text, ns, list_reduce(list_prepend({{'t': gone, 'f': '', 's': ''}}, ns), lambda p, n: {{'t': replace(p.t, n.f, n.s), 'f': '', 's': ''}}).t AS put FROM r)
SELECT doc_id, CASE WHEN ns IS NULL THEN text ELSE {strip(f"regexp_replace(put, {q(chr(10) + S + '*' + chr(10) + S + '*' + chr(10) + '+')}, chr(10) || chr(10), 'g')")} END AS noted FROM z"""


_first_part = "split_part(split_part(note, '.', 1), ',', 1)"
_add("footnotes_inline", lambda s, d: C.footnotes_inline(D.docs_aug(s, d)).select("doc_id", "noted"), _noted("CASE WHEN length(note) > 200 THEN substr(note, 1, 197) || '...' ELSE note END"))
_add("footnotes_minimal", lambda s, d: C.footnotes_inline(D.docs_aug(s, d), style="minimal").select("doc_id", "noted"), _noted(f"substr({strip(_first_part)}, 1, 100)"))
