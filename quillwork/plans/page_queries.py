"""Queries on pages, selections, filters and routing, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as P
from ..operators import quality as Q
from ..operators import routing as R
from ..sources import derived as D
from .sql import DOCS, PAGES, among, case, count, q, rlike, strip
from .sql import words as sql_words

QUERIES, ORACLES = {}, {}


def _add(name, build, sql):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


_add("page_split", lambda s, d: D.doc_pages(s, d), f"WITH {PAGES} SELECT * FROM doc_pages")

_specs = f"""WITH {PAGES}, specs AS (SELECT doc_id, ['', '1', '1-2', '1, 3', '99', 'a-b'][CAST(doc_id % 6 AS INT) + 1] AS spec FROM docs_aug),
t AS (SELECT doc_id, max(page_no) AS total FROM doc_pages GROUP BY doc_id), k AS (SELECT * FROM specs JOIN t USING (doc_id)),
p AS (SELECT doc_id, total, spec, trim(unnest(string_split(spec, ','))) AS part, generate_subscripts(string_split(spec, ','), 1) AS i FROM k WHERE spec <> ''),
n AS (SELECT *, contains(part, '-') AS rg, TRY_CAST(split_part(part, '-', 1) AS INT) AS a, TRY_CAST(CASE WHEN contains(part, '-') THEN split_part(part, '-', 2) ELSE part END AS INT) AS b FROM p),
e AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN 'Invalid page range format: ' || spec WHEN (a < 1 OR b > total OR a > b) AND rg THEN 'Invalid range ' || a || '-' || b || '. Pages must be between 1 and ' || total WHEN a < 1 OR b > total THEN 'Page ' || a || ' is out of range. Document has ' || total || ' pages' END AS error FROM n),
er AS (SELECT doc_id, arg_min(error, i) AS spec_error FROM e WHERE error IS NOT NULL GROUP BY doc_id)"""
_add("page_range_strict", lambda s, d: P.page_selection(p := D.doc_pages(s, d), D.page_specs(D.docs_aug(s, d))), f"""{_specs}
SELECT doc_id, page_no, NULL::VARCHAR AS spec_error FROM doc_pages dp WHERE EXISTS (SELECT 1 FROM k WHERE k.doc_id = dp.doc_id AND spec = '') OR (doc_id NOT IN (SELECT doc_id FROM er) AND EXISTS (SELECT 1 FROM e WHERE e.doc_id = dp.doc_id AND page_no BETWEEN a AND b))
UNION ALL SELECT doc_id, NULL, spec_error FROM er""")
_add("page_range_all", lambda s, d: P.page_selection(D.doc_pages(s, d), D.docs_aug(s, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, " ALL ").when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise("2-999, x").alias("spec")), "clip").drop("spec_error"), f"WITH {PAGES} SELECT doc_id, page_no FROM doc_pages WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR page_no >= 2")
_add("page_range_clip", lambda s, d: P.page_selection(D.doc_pages(s, d), D.page_specs(D.docs_aug(s, d)), "clip").drop("spec_error"), f"""{_specs}
SELECT doc_id, page_no FROM doc_pages dp WHERE EXISTS (SELECT 1 FROM k WHERE k.doc_id = dp.doc_id AND spec = '') OR EXISTS (SELECT 1 FROM e WHERE e.doc_id = dp.doc_id AND page_no BETWEEN a AND b)""")
_t = strip("text")
_urls = f"length(array_to_string(regexp_extract_all({_t}, {q('https?://[^' + chr(92) + 's' + chr(92) + 'x{85}' + chr(92) + 'p{Z}]+')}), ''))"
_rejects = case((f"{_t} = ''", "'blank'"), (f"starts_with({_t}, '[Page') AND contains({_t}, 'No text could be extracted')", "'no_text'"), (f"length({_t}) < 200 AND {_urls} * 10 > length({_t}) * 7", "'mostly_urls'"), otherwise="''")
_add("reject_reason", lambda s, d: P.reject_reason(D.docs_aug(s, d)).select("doc_id", F.coalesce("reject_reason", F.lit("")).alias("reject_reason")), f"WITH {DOCS} SELECT doc_id, {_rejects} AS reject_reason FROM docs_aug")

_path = "['in/annual-report_2024.PDF', 'in/plan notes.md', 'in/raw-data.csv', 'in/README', 'in/memo_for-all.txt', 'in/-.xlsx'][CAST(doc_id % 6 AS INT) + 1]"


def _files(s, d):
    names = F.array(*[F.lit(x) for x in ("in/annual-report_2024.PDF", "in/plan notes.md", "in/raw-data.csv", "in/README", "in/memo_for-all.txt", "in/-.xlsx")])
    return D.read(s, d, "documents").select("doc_id", F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int")).alias("path"), "text")


_facts = f"WITH f AS (SELECT doc_id, coalesce(text, '') AS text, {_path} AS path FROM documents), g AS (SELECT *, CASE WHEN contains(path, '.') THEN lower(regexp_extract(path, '\\.([^.]*)$', 1)) ELSE '' END AS suffix, ['Annual Report 2024', 'Plan Notes', 'Raw Data', 'Readme', 'Memo For All', 'Document'][CAST(doc_id % 6 AS INT) + 1] AS title FROM f)"
_kind = "CASE WHEN suffix IN ('xlsx', 'xls', 'csv') THEN 'sheet' WHEN suffix IN ('md', 'markdown', 'txt') THEN 'text' WHEN suffix = 'pdf' THEN 'paged' ELSE 'unsupported' END"
_add("supported_files", lambda s, d: P.file_facts(_files(s, d)).drop("text"), f"{_facts} SELECT doc_id, path, suffix, {_kind} AS kind, suffix IN ('pdf', 'md', 'markdown', 'txt', 'xlsx', 'xls', 'csv') AS supported, title FROM g")
_add("text_source", lambda s, d: P.text_source(_files(s, d)), f"{_facts} SELECT path, CASE WHEN suffix = 'txt' THEN '# ' || title || chr(10) || chr(10) || text ELSE text END AS content FROM g WHERE {_kind} = 'text'")

_add("text_recommendations", lambda s, d: P.text_recommendations(_files(s, d)), f"{_facts} SELECT path, 1::BIGINT AS page_no, 'NO' AS recommendation, 1.0::DOUBLE AS confidence, 'Text-only file' AS reason FROM g WHERE {_kind} = 'text'")


def _records(s, d):
    e = D.read(s, d, "events")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("event_id") % len(v) + 1).cast("int"))
    return e.select("event_id", F.repeat(F.lit("f"), (F.col("event_id") % 300).cast("int")).alias("filename"), (F.col("user_id") % 5).alias("page"), (F.col("event_id") % 13 / 10).alias("confidence"), (F.col("event_id") % 120).alias("progress"), (F.col("event_id") % 12).alias("header_rows"), pick("label_1", "data", "ignore", "other").alias("role"), pick("YES", "NO", "yes", "MAYBE", "YES\n").alias("recommendation"))


_add("validate_records", lambda s, d: P.violations(_records(s, d)).select("event_id", "violations", "valid"), """WITH r AS (SELECT event_id, event_id % 300 AS n, user_id % 5 AS page, event_id % 13 / 10.0::DOUBLE AS c, event_id % 120 AS p, event_id % 12 AS h, event_id % 4 = 3 AS role_bad, event_id % 5 >= 2 AS rec_bad FROM events)
SELECT event_id, concat_ws(',', CASE WHEN NOT n BETWEEN 1 AND 255 THEN 'filename' END, CASE WHEN page < 1 THEN 'page' END, CASE WHEN c > 1 THEN 'confidence' END, CASE WHEN p > 100 THEN 'progress' END, CASE WHEN h > 10 THEN 'header_rows' END, CASE WHEN role_bad THEN 'role' END, CASE WHEN rec_bad THEN 'recommendation' END) AS violations,
n BETWEEN 1 AND 255 AND page >= 1 AND c <= 1 AND p <= 100 AND h <= 10 AND NOT role_bad AND NOT rec_bad AS valid FROM r""")
_add("error_records", lambda s, d: P.error_records(P.violations(_records(s, d)), "2024-06-01 12:00:00").select("event_id", "error", "message", F.array_join(F.transform(F.array_sort(F.map_entries("details")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("details"), F.col("timestamp").cast("timestamp_ntz").alias("at")), """WITH r AS (SELECT event_id, event_id % 300 AS n, user_id % 5 AS page, event_id % 13 / 10.0::DOUBLE AS c, event_id % 120 AS p, event_id % 12 AS h, ['label_1', 'data', 'ignore', 'other'][event_id % 4 + 1] AS role, ['YES', 'NO', 'yes', 'MAYBE', 'YES' || chr(10)][event_id % 5 + 1] AS rec FROM events),
b AS (SELECT *, list_filter([CASE WHEN NOT n BETWEEN 1 AND 255 THEN 'filename' END, CASE WHEN page < 1 THEN 'page' END, CASE WHEN c > 1 THEN 'confidence' END, CASE WHEN p > 100 THEN 'progress' END, CASE WHEN h > 10 THEN 'header_rows' END, CASE WHEN role = 'other' THEN 'role' END, CASE WHEN event_id % 5 >= 2 THEN 'recommendation' END], lambda x: x IS NOT NULL) AS broken FROM r)
SELECT event_id, 'ValidationError' AS error, 'Invalid ' || array_to_string(broken, ', ') AS message, array_to_string(list_transform(list_sort(broken), lambda f: f || '=' || CASE f WHEN 'filename' THEN repeat('f', n::INT) WHEN 'page' THEN page::VARCHAR WHEN 'confidence' THEN c::VARCHAR WHEN 'progress' THEN p::VARCHAR WHEN 'header_rows' THEN h::VARCHAR WHEN 'role' THEN role ELSE rec END), ';') AS details, TIMESTAMP '2024-06-01 12:00:00' AS at FROM b WHERE len(broken) > 0""")
_add("settings_table", lambda s, d: P.clean_settings(D.page_settings(D.docs_aug(s, d))), f"WITH {DOCS} SELECT doc_id, CAST(p AS BIGINT) AS page_no, CASE p WHEN 1 THEN 'YES' ELSE 'NO' END AS setting FROM docs_aug, range(1, 3) r(p) WHERE doc_id % 3 = 0")


def _tasks(s, d):
    names = F.array(*[F.lit(x) for x in ("vision", "formatting", "evaluation", "summary", "unknown")])
    return D.read(s, d, "events").select("event_id", F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("task"))


_add("task_config", lambda s, d: P.with_task_config(_tasks(s, d), D.task_config(s)), """WITH c(task, model, provider, temperature, max_tokens) AS (VALUES ('main', 'm-large', 'a', 0.1::DOUBLE, 4000::BIGINT), ('vision', 'm-vision', 'b', 0.0, 4096), ('formatting', 'm-large', 'a', 0.2, 16000), ('evaluation', 'm-judge', 'c', 0.0, 2000), ('summary', 'm-small', NULL, 0.3, 1500)),
t AS (SELECT event_id, ['vision', 'formatting', 'evaluation', 'summary', 'unknown'][CAST(event_id % 5 AS INT) + 1] AS task FROM events), m AS (SELECT * FROM c WHERE task = 'main')
SELECT t.event_id, t.task, coalesce(c.model, m.model) AS model, coalesce(c.provider, m.provider) AS provider, coalesce(c.temperature, m.temperature) AS temperature, coalesce(c.max_tokens, m.max_tokens) AS max_tokens FROM t LEFT JOIN c USING (task), m""")


def _columns(s, d):
    return D.read(s, d, "part").select(F.lit("part").alias("sheet"), F.col("p_partkey").alias("idx_key"), (F.col("p_partkey") % 6).cast("int").alias("idx"), F.col("p_name").alias("header") if "p_name" in D.read(s, d, "part").columns else F.lit("h").alias("header"), F.when(F.col("p_partkey") % 4 == 1, "Label 2").when(F.col("p_partkey") % 4 == 2, "ignore").alias("role"))


_add("column_roles_config", lambda s, d: P.column_roles(_columns(s, d)).select(F.col("idx_key").cast("long").alias("idx_key"), "idx", "role", "type"), """WITH c AS (SELECT CAST(p_partkey AS BIGINT) AS idx_key, CAST(p_partkey % 6 AS INT) AS idx, CASE WHEN p_partkey % 4 = 1 THEN 'label_2' WHEN p_partkey % 4 = 2 THEN 'ignore' WHEN p_partkey % 6 < 3 THEN 'label_' || (p_partkey % 6 + 1) ELSE 'data' END AS role FROM part)
SELECT *, CASE WHEN starts_with(role, 'label') THEN 'text' ELSE 'data' END AS type FROM c WHERE role <> 'ignore'""")

_box = rlike("text", R.TABLE_CHARS)
_check = "(" + " OR ".join(rlike("text", p) for p in R.CHECKBOXES) + ")"
_dense = "length(replace(replace(text, ' ', ''), chr(10), ''))"
_an = f"""WITH {PAGES}, w AS (SELECT *, {sql_words('text')} AS ws, {strip('text')} = '' AS blank FROM doc_pages),
f AS (SELECT *, {_box} AS box, {count('text', R.ALIGNED)} > 3 AS aligned, {_check} AS chk, {rlike('text', R.STRUCTURED)} AS st, len(ws) > 0 AND len(list_filter(ws, lambda x: regexp_matches(x, '^\\p{{L}}\\z'))) * 10 > len(ws) AS frag,
 len(ws) > 0 AND length(array_to_string(ws, '')) * 2 < len(ws) * 5 AS short, len(ws) > 0 AND {_dense} > 0 AND {among('text', ' ')} * 2 > {_dense} AS spaced, {count('text', Q.ODD_CHARACTER)} * 100 > length(text) AS odd FROM w),
l AS (SELECT *, CAST(frag AS INT) * 3 + CAST(short AS INT) * 2 + CAST(spaced AS INT) * 2 + CAST(odd AS INT) * 2 AS lost FROM f),
an AS (SELECT doc_id, page_no, text, NOT blank AND (box OR aligned) AS has_tables, NOT blank AND chk AS has_checkboxes, NOT blank AND st AS has_structured, CASE WHEN blank THEN 0.0 ELSE (10 - lost) / 10.0::DOUBLE END AS quality_score, CASE WHEN blank THEN 'missing' WHEN lost > 3 THEN 'poor' WHEN lost > 1 THEN 'fair' ELSE 'good' END AS text_quality,
 CASE WHEN blank THEN 'no_text_extracted' ELSE concat_ws(',', CASE WHEN box THEN 'table_detected' END, CASE WHEN aligned THEN 'aligned_columns' END, CASE WHEN chk THEN 'checkboxes_detected' END, CASE WHEN st THEN 'structured_data' END, CASE WHEN frag THEN 'fragmented_words' END, CASE WHEN short THEN 'short_words' END, CASE WHEN spaced THEN 'spacing_corruption' END, CASE WHEN odd THEN 'encoding_issues' END) END AS indicators FROM l)"""
_add("page_analysis", lambda s, d: R.analyse_pages(D.doc_pages(s, d)).drop("text").withColumn("indicators", F.array_join("indicators", ",")), f"{_an} SELECT doc_id, page_no, has_tables, has_checkboxes, has_structured, quality_score, text_quality, indicators FROM an")
_visual = """, v AS (SELECT *, (doc_id * 3 + page_no) % 5 < 2 AS h, (doc_id + page_no) % 4 AS m FROM an),
r AS (SELECT *, h AND m = 0 AS tb, h AND m = 1 AS ch, h AND m = 2 AS lay, h AND m = 3 AS img FROM v)"""
_route = f"""{_visual}, z AS (SELECT *, concat_ws(',', CASE WHEN tb THEN 'table' END, CASE WHEN ch THEN 'chart' END, CASE WHEN lay THEN 'complex_layout' END, CASE WHEN img THEN 'poor_image_quality' END, CASE WHEN has_tables THEN 'table_text' END, CASE WHEN has_checkboxes THEN 'checkbox' END, CASE WHEN text_quality = 'poor' THEN 'poor_text' END) AS els,
 concat_ws(', ', CASE WHEN tb THEN 'tables detected in image' END, CASE WHEN ch THEN 'charts/graphs detected' END, CASE WHEN lay THEN 'complex layout' END, CASE WHEN img THEN 'poor image quality detected' END, CASE WHEN has_tables THEN 'table patterns in extracted text' END, CASE WHEN has_checkboxes THEN 'checkbox patterns detected' END, CASE WHEN text_quality = 'poor' THEN 'poor text extraction quality' END) AS why,
 tb OR ch OR has_checkboxes AS strong, text_quality IN ('poor', 'missing') OR img OR quality_score < 0.7 AS weak FROM r)"""
_method = """CASE WHEN strong OR weak THEN 'vision' ELSE 'tesseract' END AS method, CASE WHEN strong THEN CASE WHEN img THEN 0.7 ELSE 0.8 END WHEN weak AND text_quality = 'missing' THEN CASE WHEN img THEN 0.7 ELSE 0.8 END WHEN weak THEN CASE WHEN img THEN 0.6 ELSE 0.7 END WHEN text_quality = 'good' AND els = '' THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence, CASE WHEN NOT strong AND NOT weak AND text_quality = 'good' AND els = '' THEN 'clean_text' ELSE els END AS elements"""
_reason = """CASE WHEN strong THEN 'Visual elements require vision OCR: ' || why WHEN weak THEN 'Text quality issues detected: ' || concat_ws(', ', CASE WHEN why <> '' THEN why END, CASE WHEN text_quality = 'missing' THEN 'minimal/no text extracted - likely image-based document' END) WHEN text_quality = 'good' AND els = '' THEN 'Clean text with no visual elements, optimal for Tesseract' ELSE 'Conservative routing to Tesseract: ' || CASE WHEN why <> '' THEN why ELSE 'standard processing' END END AS reasoning"""
_routed = lambda s, d: R.route(R.analyse_pages(D.visual_flags(D.doc_pages(s, d))))
_add("route_pages", lambda s, d: _routed(s, d).select("doc_id", "page_no", "method", "confidence", F.array_join("elements", ",").alias("elements")), f"{_an}{_route} SELECT doc_id, page_no, {_method} FROM z")
_add("route_reason", lambda s, d: _routed(s, d).select("doc_id", "page_no", (F.col("method") == "vision").alias("use_vision"), "reasoning"), f"{_an}{_route} SELECT doc_id, page_no, strong OR weak AS use_vision, {_reason} FROM z")
_add("route_quota", lambda s, d: R.with_quota(D.doc_pages(s, d), 3).select("doc_id", "page_no", "used_before", "over_quota"), f"WITH {PAGES} SELECT doc_id, page_no, page_no - 1 AS used_before, page_no - 1 >= 3 AS over_quota FROM doc_pages")
_add("route_override", lambda s, d: R.routed(D.doc_pages(s, d), P.clean_settings(D.page_settings(D.docs_aug(s, d))), 3).select("doc_id", "page_no", "used_before", "method", "use_vision"), f"""{_an}, o AS (SELECT *, CASE WHEN doc_id % 3 = 0 AND page_no = 1 THEN 'vision' WHEN doc_id % 3 = 0 AND page_no = 2 THEN 'tesseract' END AS ov FROM an),
u AS (SELECT *, CAST(coalesce(sum(CASE WHEN ov IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_before FROM o),
m AS (SELECT *, coalesce(ov, CASE WHEN used_before >= 3 THEN 'tesseract' WHEN has_checkboxes OR text_quality IN ('poor', 'missing') OR quality_score < 0.7 THEN 'vision' ELSE 'tesseract' END) AS method FROM u)
SELECT doc_id, page_no, used_before, method, method = 'vision' AS use_vision FROM m""")
_att = f"""WITH {PAGES}, att AS (SELECT doc_id, page_no, text, CAST(a AS INT) AS attempt, CASE WHEN a < 3 THEN 'vision' ELSE 'tesseract' END AS method, (doc_id + page_no * 3 + a * 2) % 7 < 2 AS success, CASE WHEN (doc_id + page_no * 3 + a * 2) % 7 < 2 THEN 'v' || a || ': ' || text END AS content FROM doc_pages, range(1, 4) r(a))"""
_add("resolve_fallback", lambda s, d: R.resolve_attempts(p := D.doc_pages(s, d), D.attempts(p)).select("doc_id", "page_no", "chosen_method", "content"), f"""{_att}, b AS (SELECT doc_id, page_no, any_value(text) AS text, arg_min(content, attempt) FILTER (WHERE success AND method = 'vision') AS v, arg_min(content, attempt) FILTER (WHERE success AND method = 'tesseract') AS t FROM att GROUP BY doc_id, page_no)
SELECT doc_id, page_no, CASE WHEN v IS NOT NULL THEN 'vision' WHEN {strip('text')} <> '' THEN 'direct' WHEN t IS NOT NULL THEN 'tesseract' ELSE 'none' END AS chosen_method, coalesce(v, CASE WHEN {strip('text')} <> '' THEN text END, t, '') AS content FROM b""")
_add("page_errors", lambda s, d: R.isolate_errors(p := D.doc_pages(s, d), D.attempts(p)), f"""{_att}, b AS (SELECT doc_id, page_no, max(success) AS ok, arg_min(content, attempt) FILTER (WHERE success) AS c FROM att GROUP BY doc_id, page_no)
SELECT doc_id, page_no, ok AS success, CASE WHEN NOT ok THEN '## Page ' || page_no || chr(10) || chr(10) || '[Error: extraction failed]' WHEN {strip("coalesce(c, '')")} = '' THEN '## Page ' || page_no || chr(10) || chr(10) || '[No text extracted]' ELSE c END AS content FROM b""")
_metrics = "WITH m AS (SELECT page_id, CAST(length(regexp_replace(html, '<[^>]*>', '', 'g')) AS BIGINT) AS text_len, CAST(page_id % 5 = 0 AS BIGINT) AS images, CAST(len(regexp_extract_all(html, '<ul')) AS BIGINT) AS drawings, CAST(len(regexp_extract_all(html, '<p')) + len(regexp_extract_all(html, '<li')) AS BIGINT) AS blocks FROM pages)"
_heur = case(("text_len < 50 AND images = 0", "{0}"), ("images > 0", "{1}"), ("drawings > 100 OR drawings * 100 > greatest(text_len, 1) * 20", "{2}"), ("text_len > 500", "{3}"), ("blocks > 30", "{4}"), ("text_len > 200", "{5}"), otherwise="{6}")
_hr, _hc, _hn = (_heur.format(*v) for v in (("'NO'", "'YES'", "'YES'", "'NO'", "'YES'", "'NO'", "'UNCERTAIN'"), ("0.95", "0.9", "0.85", "0.85", "0.7", "0.75", "0.5"), ("'Nearly blank page'", "'Contains images'", "'Contains graphics/charts'", "'Text-rich page'", "'Complex layout'", "'Standard text page'", "'Needs analysis'")))
_add("page_heuristic", lambda s, d: R.page_heuristic(D.page_metrics(D.read(s, d, "pages"))), f"{_metrics} SELECT *, {_hr} AS recommendation, CAST({_hc} AS DOUBLE) AS confidence, {_hn} AS heuristic FROM m")


def _second(s, d):
    return D.read(s, d, "pages").where("page_id % 3 <> 1").select("page_id", F.when(F.col("page_id") % 2 == 0, "NO").alias("s_recommendation"), F.when(F.col("page_id") % 4 == 0, F.lit(0.6)).alias("s_confidence"), F.concat(F.lit("second look at "), "url", F.lit(" with a long reason attached")).alias("s_reason"))


def _escalated(s, d):
    m = D.page_metrics(D.read(s, d, "pages")).withColumn("text_len", F.col("text_len") % 600)
    return R.escalate(R.page_heuristic(m), _second(s, d))


_esc = f"""{_metrics}, m2 AS (SELECT * REPLACE (text_len % 600 AS text_len) FROM m), h AS (SELECT page_id, {_hr} AS recommendation, CAST({_hc} AS DOUBLE) AS confidence, {_hn} AS heuristic FROM m2),
j AS (SELECT h.*, p.url, h.page_id % 3 <> 1 AS found FROM h JOIN pages p USING (page_id)),
f AS (SELECT page_id, CASE WHEN confidence > 0.8 THEN recommendation WHEN found AND page_id % 2 = 0 THEN 'NO' ELSE 'YES' END AS final, CASE WHEN confidence > 0.8 THEN confidence WHEN found THEN CASE WHEN page_id % 4 = 0 THEN 0.6 ELSE 0.7 END ELSE 0.5 END::DOUBLE AS final_confidence, CASE WHEN confidence > 0.8 THEN 'heuristic' ELSE 'vision' END AS method,
 substr(CASE WHEN confidence > 0.8 THEN heuristic WHEN found THEN 'second look at ' || url || ' with a long reason attached' ELSE 'analysis failed' END, 1, 50) AS reason FROM j)"""
_add("escalation", lambda s, d: _escalated(s, d).select("page_id", "final", "final_confidence", "method", "reason"), f"{_esc} SELECT * FROM f")
_add("recommendation_summary", lambda s, d: R.recommendation_summary(_escalated(s, d).withColumn("batch", F.col("page_id") % 10), "batch"), f"{_esc} SELECT page_id % 10 AS batch, count(*) FILTER (WHERE final = 'YES') AS yes_pages, count(*) FILTER (WHERE final = 'NO') AS no_pages, count(*) FILTER (WHERE method = 'heuristic') AS heuristic_pages, count(*) FILTER (WHERE method = 'vision') AS vision_pages FROM f GROUP BY 1")


def _replies(s, d):
    forms = F.array(*[F.lit(x) for x in ('```json\n{"has_tables": true, "layout_complexity": "complex"}\n```', 'Sure: {"has_charts": true, "image_quality": "poor", "note": "a } brace"} done', '{"has_forms": true, "image_quality": "po', "The page has a table and a chart.")])
    return D.read(s, d, "documents").select("doc_id", F.element_at(forms, (F.col("doc_id") % 4 + 1).cast("int")).alias("response"))


_add("visual_response_parse", lambda s, d: R.parse_visual(_replies(s, d)).drop("response"), """SELECT doc_id, doc_id % 4 < 3 AS parsed, doc_id % 4 IN (0, 3) AS v_tables, doc_id % 4 IN (1, 3) AS v_charts, doc_id % 4 = 2 AS v_forms, ['complex', 'simple', 'simple', 'moderate'][CAST(doc_id % 4 AS INT) + 1] AS v_layout, ['good', 'poor', 'po', 'good'][CAST(doc_id % 4 AS INT) + 1] AS v_image FROM documents""")
