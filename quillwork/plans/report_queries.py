"""Queries on evaluation, plan records, summaries, accounting and the cache, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import pages as PG
from ..operators import plan_tables as L
from ..operators import report_layouts as LY
from ..operators import runs as A
from ..operators import summary as M
from ..functions.text import word_count
from ..sources import derived as D
from .sql import DOCS, PAGES, S, lines, q, strip
from .sql import words as sql_words
from .text_queries import _fmt, _formatted

QUERIES, ORACLES = {}, {}


def _add(name, build, sql):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


# ---- missing and added content
_norm = strip(f"lower(regexp_replace(l, {q(S + '+')}, ' ', 'g'))")
_sets = f"""WITH {DOCS}, fm AS (SELECT *, {_fmt} FROM docs_aug), ss AS (SELECT DISTINCT doc_id, {_norm} AS item FROM (SELECT doc_id, unnest({lines('text')}) AS l FROM fm)), ff AS (SELECT DISTINCT doc_id, {_norm} AS item FROM (SELECT doc_id, unnest({lines('formatted')}) AS l FROM fm)),
sr AS (SELECT * FROM ss WHERE item <> '' AND NOT regexp_matches(item, '^(page )?[0-9]+( of [0-9]+)?$|^-+$')), ou AS (SELECT * FROM ff WHERE item <> '' AND NOT regexp_matches(item, '^(page )?[0-9]+( of [0-9]+)?$|^-+$')),
ms AS (SELECT * FROM sr EXCEPT SELECT * FROM ou), ad AS (SELECT * FROM ou EXCEPT SELECT * FROM sr)"""
_pairs = lambda s, d: _formatted(D.docs_aug(s, d))
_add("missing_items", lambda s, d: E.missing_items(_pairs(s, d)), f"{_sets} SELECT * FROM ms")
_add("added_items", lambda s, d: E.added_items(_pairs(s, d)), f"{_sets} SELECT * FROM ad")
_rec = "CASE WHEN {0} >= 90 THEN 'ACCEPT' WHEN {0} >= 70 THEN 'REVIEW' ELSE 'REJECT' END"
_add("rate_documents", lambda s, d: E.rate_documents(_pairs(s, d)), f"""{_sets}, a AS (SELECT doc_id, count(*) AS n_lines FROM sr GROUP BY 1), b AS (SELECT doc_id, count(*) AS n_missing FROM ms GROUP BY 1), c AS (SELECT doc_id, count(*) AS n_added FROM ad GROUP BY 1),
z AS (SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_missing, 0) AS n_missing, coalesce(n_added, 0) AS n_added FROM docs_aug LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)), y AS (SELECT *, CASE WHEN n_lines > 0 THEN (n_lines - n_missing) * 100 / CAST(n_lines AS DOUBLE) ELSE 100.0 END AS score FROM z) SELECT *, {_rec.format('score')} AS recommendation FROM y""")


# ---- raters
def _replies(s, d, shift=0):
    k = f"(doc_id + {shift}) % 5"
    sc = f"cast(60 + (doc_id * 7 + {shift} * 13) % 41 as string)"
    body = f"concat('{{\"overall_score\": ', {sc}, ', \"recommendation\": \"', element_at(array('ACCEPT', 'REVIEW', 'REJECT'), cast((doc_id + {shift}) % 3 + 1 as int)), '\", \"missing_items\": [{{\"content\": \"A\"}}, {{\"content\": \" b', cast((doc_id + {shift}) % 2 as string), '\"}}], \"added_items\": []}}')"
    reply = f"CASE {k} WHEN 0 THEN {body} WHEN 1 THEN concat('Here:\\n```json\\n', {body}, '\\n```\\nend') WHEN 2 THEN concat('I think ', {body}, ' is right') WHEN 3 THEN concat('overall_score: ', {sc}, '.5 so reject') ELSE 'no idea' END"
    return D.read(s, d, "documents").selectExpr("doc_id", f"{reply} AS response")


def _rated(s, d, shift=0):
    return E.parse_ratings(_replies(s, d, shift))


def _rated_sql(shift):
    k, sc = f"(doc_id + {shift}) % 5", f"60 + (doc_id * 7 + {shift} * 13) % 41"
    return f"""SELECT doc_id, CASE {k} WHEN 0 THEN 'whole' WHEN 1 THEN 'fenced' WHEN 2 THEN 'object' ELSE 'text' END AS read_as, CASE WHEN {k} < 3 THEN {sc} WHEN {k} = 3 THEN {sc} + 0.5 ELSE 0 END::DOUBLE AS score,
CASE WHEN {k} < 3 THEN ['ACCEPT', 'REVIEW', 'REJECT'][CAST((doc_id + {shift}) % 3 AS INT) + 1] WHEN {k} = 3 THEN 'REJECT' ELSE 'REVIEW' END AS recommendation, CASE WHEN {k} < 3 THEN ['A', ' b' || (doc_id + {shift}) % 2] ELSE CAST([] AS VARCHAR[]) END AS missing, CAST([] AS VARCHAR[]) AS added FROM documents"""


_add("parse_ratings", lambda s, d: _rated(s, d).select("doc_id", "read_as", "score", "recommendation", F.array_join("missing", ",").alias("missing"), F.array_join("added", ",").alias("added")), f"SELECT * REPLACE (array_to_string(missing, ',') AS missing, array_to_string(added, ',') AS added) FROM ({_rated_sql(0)})")
_two = f"WITH a AS ({_rated_sql(0)}), b AS (SELECT * FROM ({_rated_sql(1)}) WHERE doc_id % 4 <> 0), j AS (SELECT a.doc_id, a.score, a.recommendation, a.missing, b.score AS bs, b.recommendation AS br, b.missing AS bm FROM a LEFT JOIN b USING (doc_id)), r AS (SELECT *, CASE recommendation WHEN 'ACCEPT' THEN 0 WHEN 'REVIEW' THEN 1 ELSE 2 END AS ra, CASE br WHEN 'ACCEPT' THEN 0 WHEN 'REVIEW' THEN 1 ELSE 2 END AS rb, list_distinct(list_transform(missing, lambda x: trim(lower(x)))) AS x, list_distinct(list_transform(bm, lambda x: trim(lower(x)))) AS y FROM j)"
_compared = lambda s, d: E.compare_raters(_rated(s, d), _rated(s, d, 1).where("doc_id % 4 <> 0"))
_final = f"CASE WHEN bs IS NOT NULL THEN {_rec.format('(score + bs) / 2')} ELSE recommendation END"
_fs = "CASE WHEN bs IS NOT NULL THEN (score + bs) / 2 ELSE score END"
_add("compare_raters", lambda s, d: _compared(s, d).select("doc_id", "final_score", "agreement", "final_recommendation", "gap", "same", "adjacent", "summary"), f"{_two} SELECT doc_id, {_fs} AS final_score, CASE WHEN bs IS NOT NULL THEN (score + bs) / 2 ELSE 100.0 END AS agreement, {_final} AS final_recommendation, CASE WHEN bs IS NOT NULL THEN abs(score - bs) ELSE 0.0 END AS gap, coalesce(recommendation = br, false) AS same, br IS NOT NULL AND abs(ra - rb) = 1 AS adjacent, 'final ' || format('{{:.1f}}', {_fs}) || ' ' || {_final} || CASE WHEN bs IS NOT NULL AND recommendation <> br THEN ' (raters disagree)' ELSE '' END AS summary FROM r")
_add("item_overlap", lambda s, d: _compared(s, d).where("b_score is not null").select("doc_id", "missing_overlap", "added_overlap"), f"{_two} SELECT doc_id, CASE WHEN len(missing) = 0 AND len(bm) = 0 THEN 100.0 WHEN len(missing) = 0 OR len(bm) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) * 100 / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) END AS missing_overlap, 100.0::DOUBLE AS added_overlap FROM r WHERE bs IS NOT NULL")
_items = "CASE WHEN len({0}) > 0 THEN '1. ' || {0}[1] || chr(10) || '2. ' || {0}[2] ELSE 'None' END"
_part = "'## {0}' || chr(10) || 'Score: ' || format('{{:.1f}}', {1}) || '/100' || chr(10) || 'Recommendation: ' || {2} || chr(10) || 'Missing:' || chr(10) || {3} || chr(10) || 'Added:' || chr(10) || 'None'"
_add("eval_report", lambda s, d: E.eval_report(_compared(s, d)), f"{_two} SELECT doc_id, {_part.format('Rater A', 'score', 'recommendation', _items.format('missing'))} || chr(10) || chr(10) || CASE WHEN bs IS NOT NULL THEN {_part.format('Rater B', 'bs', 'br', _items.format('bm'))} ELSE '## Rater B' || chr(10) || 'Not available' END || chr(10) || chr(10) || '## Final' || chr(10) || 'Average: ' || format('{{:.1f}}', {_fs}) || '/100' || chr(10) || 'Recommendation: ' || {_final} AS report FROM r")
_add("parse_report", lambda s, d: E.parse_report(E.eval_report(_compared(s, d))), f"{_two} SELECT doc_id, 'Rater A' AS section, CAST(format('{{:.1f}}', score) AS DOUBLE) AS score, recommendation FROM r UNION ALL SELECT doc_id, 'Rater B', CAST(format('{{:.1f}}', bs) AS DOUBLE), br FROM r UNION ALL SELECT doc_id, 'Final', CAST(format('{{:.1f}}', {_fs}) AS DOUBLE), {_final} FROM r")
_AB = ("RATER A", "RATER B")


def _free_reports(s, d):
    """Reports of four layouts around whole texts: with and without a rule, the second rater's values near or beyond the text."""
    k, rule = "doc_id % 4", "repeat('=', 40)"
    late = "concat('\\nScore: ', cast(doc_id % 90 as string), ' / 100\\nRecommendation: REVIEW')"
    report = f"""concat('Report\\nRATER A EVALUATION\\nScore: ', cast(doc_id % 101 as string), '.0/100\\nRecommendation: ACCEPT with care\\n', CASE WHEN {k} IN (1, 3) THEN {rule} ELSE '--' END,
        CASE WHEN {k} = 3 THEN '' ELSE concat('\\nRATER B EVALUATION', CASE WHEN {k} = 0 THEN {late} ELSE '' END) END, '\\n', coalesce(text, ''), {late}, '\\nEVALUATOR COMPARISON\\nAverage: ', cast(doc_id % 77 as string), '.5/100')"""
    return D.read(s, d, "documents").selectExpr("doc_id", f"CASE WHEN doc_id % 11 = 10 THEN ' ' ELSE {report} END AS report")


_late = "chr(10) || 'Score: ' || doc_id % 90 || ' / 100' || chr(10) || 'Recommendation: REVIEW'"
_free = f"""WITH rp AS (SELECT doc_id, CASE WHEN doc_id % 11 = 10 THEN ' ' ELSE 'Report' || chr(10) || 'RATER A EVALUATION' || chr(10) || 'Score: ' || doc_id % 101 || '.0/100' || chr(10) || 'Recommendation: ACCEPT with care' || chr(10) || CASE WHEN doc_id % 4 IN (1, 3) THEN repeat('=', 40) ELSE '--' END
 || CASE WHEN doc_id % 4 = 3 THEN '' ELSE chr(10) || 'RATER B EVALUATION' || CASE WHEN doc_id % 4 = 0 THEN {_late} ELSE '' END END || chr(10) || coalesce(text, '') || {_late} || chr(10) || 'EVALUATOR COMPARISON' || chr(10) || 'Average: ' || doc_id % 77 || '.5/100' END AS report FROM documents),
li AS (SELECT doc_id, unnest({lines('report')}) AS l, generate_subscripts({lines('report')}, 1) AS i FROM rp), ra(rater) AS (VALUES ('RATER A'), ('RATER B'))"""
_told = f"""SELECT doc_id, rater, coalesce({strip("split_part(split_part(s, 'Score:', 2), '/', 1)")} || '/100', 'N/A') AS score, coalesce(nullif(regexp_extract({strip("split_part(r, 'Recommendation:', 2)")}, '^\\S+'), ''), 'UNKNOWN') AS recommendation FROM rp CROSS JOIN ra LEFT JOIN (SELECT doc_id, rater, arg_min(l, i) FILTER (WHERE contains(l, 'Score:')) AS s, arg_min(l, i) FILTER (WHERE contains(l, 'Recommendation:')) AS r FROM held GROUP BY 1, 2) USING (doc_id, rater)"""
_add("rater_values_near", lambda s, d: LY.rater_values(_free_reports(s, d), _AB), f"""{_free}, fm AS (SELECT doc_id, rater, min(i) AS a FROM li, ra WHERE contains(l, rater || ' EVALUATION') GROUP BY 1, 2), nr AS (SELECT rater, li.* FROM li JOIN fm USING (doc_id) WHERE i > a AND i <= a + 9),
st AS (SELECT doc_id, rater, min(i) AS z FROM nr WHERE contains(l, 'EVALUATION') AND NOT contains(l, rater) GROUP BY 1, 2), held AS (SELECT nr.* FROM nr LEFT JOIN st USING (doc_id, rater) WHERE z IS NULL OR i <= z) {_told}""")
_add("rater_values_ruled", lambda s, d: LY.rater_values(_free_reports(s, d), _AB, "ruled"), f"""{_free}, ev AS (SELECT rater, li.*, CASE WHEN contains(l, rater) AND contains(l, 'EVALUATION') THEN 'open' WHEN length(l) - length(replace(l, '=', '')) > 10 THEN 'close' END AS e FROM li, ra),
held AS (SELECT * FROM (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY doc_id, rater ORDER BY i) AS state FROM ev) WHERE state = 'open' AND e IS NULL) {_told}""")
_add("split_reports", lambda s, d: LY.split_reports(_free_reports(s, d), _AB), f"""{_free}, ev AS (SELECT *, CASE WHEN contains(l, 'RATER A EVALUATION') THEN 'RATER A' WHEN contains(l, 'RATER B EVALUATION') THEN 'RATER B' WHEN contains(l, 'DEBUG INFORMATION') OR contains(l, 'EVALUATOR COMPARISON') THEN '' END AS e FROM li),
se AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS rater FROM ev) SELECT doc_id, rater, body FROM rp CROSS JOIN ra LEFT JOIN (SELECT doc_id, rater, string_agg(CASE WHEN e IS NULL THEN l ELSE '## Rater ' || right(rater, 1) || ' Evaluation' END, chr(10) ORDER BY i) AS body FROM se GROUP BY 1, 2) USING (doc_id, rater)""")
_add("report_overview", lambda s, d: LY.report_overview(_free_reports(s, d)), f"""{_free} SELECT doc_id, CASE WHEN trim(report) = '' THEN 'none' WHEN contains(report, 'RATER A EVALUATION') AND contains(report, 'RATER B EVALUATION') THEN 'dual' ELSE 'single' END AS layout, coalesce({strip("split_part(v, 'Average:', 2)")}, 'Unknown') AS average FROM rp LEFT JOIN (SELECT doc_id, arg_min(l, i) AS v FROM li WHERE contains(l, 'Average:') GROUP BY 1) USING (doc_id)""")
_add("sample_pages", lambda s, d: E.sample_pages(D.doc_pages(s, d)), f"WITH {PAGES} SELECT * FROM doc_pages WHERE page_no <= 5")
_add("display_values", lambda s, d: _rated(s, d).select("doc_id", PG.score_display(F.col("score")).alias("shown"), PG.short_number(F.col("doc_id") * 12345).alias("short"), PG.color_of(F.col("recommendation")).alias("color")), f"WITH a AS ({_rated_sql(0)}) SELECT doc_id, format('{{:.1f}}', score) || '/100' AS shown, CASE WHEN doc_id * 12345 >= 1000000 THEN format('{{:.1f}}', doc_id * 12345 / 1000000.0::DOUBLE) || 'M' WHEN doc_id * 12345 >= 1000 THEN format('{{:.1f}}', doc_id * 12345 / 1000.0::DOUBLE) || 'K' ELSE CAST(doc_id * 12345 AS VARCHAR) END AS short, CASE recommendation WHEN 'ACCEPT' THEN '#17702E' WHEN 'REVIEW' THEN '#BE8200' ELSE '#FF453A' END AS color FROM a")


# ---- plan records
def _plans(s, d):
    """Replies with three plans: the third repeats the first one's premiums for even ids and lacks copays for every third."""
    first = '{"plan_name": "Gold", "network": null, "premiums": {"single": 10, "family": 30.5}, "deductibles": {"single": 500}, "copays": {"pcp": 20}, "rx_tiers": {"tier_1": "$5"}}'
    second = '{"plan_name": "Silver", "network": null, "premiums": {"single": 7, "family": null}, "deductibles": {"single": 500}, "copays": {"pcp": null}, "rx_tiers": {"tier_1": "$5"}}'
    even, third = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
    last = F.concat(F.lit('{"plan_name": "Bronze", "network": "PPO", "coinsurance": "80%", "premiums": '), F.when(even, '{"family": 30.5, "single": 10}').otherwise('{"single": 11}'), F.lit(', "deductibles": {"single": 1500}, "copays": '), F.when(third, "null").otherwise('{"er_visit": 150}'), F.lit("}"))
    reply = F.concat(F.lit('```json\n{"plans": [' + first + ", " + second + ", "), last, F.lit("]}\n```"))
    return D.read(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 6, "sorry [UNCLEAR]").otherwise(reply).alias("response"))


_parsed = lambda s, d: L.parse_plans(_plans(s, d))
_ok = "doc_id % 7 <> 6"
_add("parse_plans", lambda s, d: _parsed(s, d).select("doc_id", "n_plans", "n_unclear", F.coalesce("error", F.lit("")).alias("error"), F.array_join(F.col("plans.plan_name"), ",").alias("names")), f"SELECT doc_id, CAST(CASE WHEN {_ok} THEN 3 ELSE 0 END AS BIGINT) AS n_plans, CAST(CASE WHEN {_ok} THEN 0 ELSE 1 END AS BIGINT) AS n_unclear, CASE WHEN {_ok} THEN '' ELSE 'unreadable reply' END AS error, CASE WHEN {_ok} THEN 'Gold,Silver,Bronze' ELSE '' END AS names FROM documents")
_add("duplicate_premiums", lambda s, d: L.duplicate_premiums(_parsed(s, d)), f"SELECT doc_id, 'Bronze' AS plan_name, 'DUPLICATE PREMIUMS: Bronze has same premiums as another plan' AS warning FROM documents WHERE {_ok} AND doc_id % 2 = 0")
_add("missing_plan_sections", lambda s, d: L.missing_sections(_parsed(s, d)), f"SELECT doc_id, CASE WHEN {_ok} THEN 'Bronze' END AS plan_name, CASE WHEN {_ok} THEN 'copays' END AS section, CASE WHEN {_ok} THEN 'Bronze: Missing copay data' ELSE 'No plans found in extracted data' END AS warning FROM documents WHERE NOT ({_ok}) OR doc_id % 3 = 0")
_add("null_leaves", lambda s, d: L.null_leaves(_parsed(s, d)), f"WITH d AS (SELECT doc_id FROM documents WHERE {_ok}), v(plan_name, path) AS (VALUES ('Gold', 'network'), ('Gold', 'coinsurance'), ('Silver', 'network'), ('Silver', 'coinsurance'), ('Silver', 'premiums.family'), ('Silver', 'copays.pcp')) SELECT doc_id, plan_name, path, plan_name || '.' || path || ': Value is null' AS warning FROM d, v")


def _deep(s, d):
    """Replies with nulls down to four levels, under keys that no schema names, in one plan without a name; a list holds one, too."""
    k = F.col("doc_id").cast("string")
    reply = F.concat(F.lit('```json\n{"plans": [{"plan_name": "P'), k, F.lit('", "x": {"y": {"z": {"w": null, "v": '), F.when(F.col("doc_id") % 3 == 0, "null").otherwise("1"), F.lit('}}, "list": [{"q": null}]}, "no": '), F.when(F.col("doc_id") % 2 == 0, "null").otherwise('"yes"'), F.lit('}, {"only": {"n": null}}, null, 7]}\n```'))
    return D.read(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 6, "sorry").when(F.col("doc_id") % 7 == 5, '{"plans": {}}').otherwise(reply).alias("response"))


_add("null_paths", lambda s, d: L.null_paths(_deep(s, d)), """WITH d AS (SELECT doc_id FROM documents WHERE doc_id % 7 < 5), n AS (SELECT doc_id, 'P' || doc_id AS plan_name, unnest(['x.y.z.w', CASE WHEN doc_id % 3 = 0 THEN 'x.y.z.v' END, CASE WHEN doc_id % 2 = 0 THEN 'no' END]) AS path FROM d UNION ALL SELECT doc_id, 'Plan 2', 'only.n' FROM d)
SELECT *, plan_name || '.' || path || ': Value is null' AS warning FROM n WHERE path IS NOT NULL""")
_md = lambda *x: " || chr(10) || ".join(q(v) for v in x)
_add("plan_markdown", lambda s, d: L.plan_markdown(_parsed(s, d)), f"""WITH d AS (SELECT doc_id FROM documents WHERE {_ok}) SELECT doc_id, 0::BIGINT AS i, {_md('## Gold', '### Premiums', '- Family: $30.50', '- Single: $10.00', '### Deductibles', '- Single: $500.00', '### Copays', '- PCP: $20.00')} AS markdown FROM d
UNION ALL SELECT doc_id, 1, {_md('## Silver', '### Premiums', '- Single: $7.00', '### Deductibles', '- Single: $500.00')} FROM d
UNION ALL SELECT doc_id, 2, {_md('## Bronze', 'Network: PPO', '### Premiums')} || chr(10) || CASE WHEN doc_id % 2 = 0 THEN {_md('- Family: $30.50', '- Single: $10.00')} ELSE '- Single: $11.00' END || chr(10) || {_md('### Deductibles', '- Single: $1,500.00')} || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || {_md('### Copays', '- ER VISIT: $150.00')} END FROM d""")

# ---- summaries
_any = lambda x, ks: "(" + " OR ".join(f"contains(lower({x}), {q(k)})" for k in ks) + ")"
_hits = lambda x, ks: "(" + " + ".join(f"CAST(contains(lower({x}), {q(k)}) AS INT)" for k in ks) + ")"
_kw = f"""kw AS (SELECT doc_id, text, list_filter(list_transform({lines('text')}, lambda l: {strip('l')}), lambda l: length(l) > 20 AND {_any('l', M.LINE_KEYWORDS)}) AS k FROM docs_aug),
ks AS (SELECT doc_id, text, CAST(len(k) AS BIGINT) AS n_found, CASE WHEN len(k) > 0 THEN array_to_string(list_transform(k[1:10], lambda l: '- ' || l), chr(10)) || CASE WHEN len(k) > 10 THEN chr(10) || (len(k) - 10) || ' more' ELSE '' END ELSE 'No specific information was identified.' END AS summary FROM kw)"""
_add("keyword_lines", lambda s, d: M.keyword_lines(D.docs_aug(s, d)), f"WITH {DOCS}, {_kw} SELECT doc_id, summary, n_found FROM ks")
_rank = f"""{DOCS}, pa AS (SELECT doc_id, text, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS pos FROM docs_aug), pb AS (SELECT *, {_hits('p', M.PARAGRAPH_KEYWORDS)} + CASE WHEN contains(p, '$') THEN 2 ELSE 0 END + CASE WHEN contains(p, '%') THEN 1 ELSE 0 END AS score FROM pa WHERE {strip('p')} <> ''),
pr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM pb)"""
_add("paragraph_rank", lambda s, d: M.paragraph_rank(D.docs_aug(s, d)), f"WITH {_rank} SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(score AS BIGINT) AS score, rank FROM pr")
_cut = "substr(p, 1, 450 - used)"
_lastdot = f"(length({_cut}) - strpos(reverse({_cut}), ' .'))"
_add("smart_truncate", lambda s, d: M.smart_truncate(D.docs_aug(s, d), 500), f"""WITH RECURSIVE {_rank}, w AS (SELECT doc_id, 0::BIGINT AS r, CAST([] AS VARCHAR[]) AS o, 0::BIGINT AS used, false AS done FROM docs_aug
UNION ALL SELECT w.doc_id, r + 1, CASE WHEN done THEN o WHEN used + length(p) + 2 <= 500 THEN list_append(o, p) WHEN used < 400 AND 450 - used > 100 THEN list_append(o, CASE WHEN strpos(reverse({_cut}), ' .') > 0 AND ({_lastdot} - 1) * 2 > 450 - used THEN substr({_cut}, 1, {_lastdot}) ELSE {_cut} END) ELSE o END,
 CASE WHEN NOT done AND used + length(p) + 2 <= 500 THEN used + length(p) + 2 ELSE used END, done OR (used + length(p) + 2 > 500 AND used < 400 AND 450 - used > 100) FROM w JOIN pr ON pr.doc_id = w.doc_id AND pr.rank = w.r + 1),
l AS (SELECT doc_id, arg_max(o, r) AS o FROM w GROUP BY doc_id), t AS (SELECT doc_id, text, array_to_string(o, chr(10) || chr(10)) AS cut FROM l JOIN docs_aug USING (doc_id))
SELECT doc_id, CASE WHEN length(cut) < length(text) THEN cut || {q(M.NOTICE)} ELSE cut END AS text FROM t""")
_units = f"({_hits('text', M.SUMMARY_KEYWORDS)} * 200 + least(length(text), 500) * 18 / 5.0::DOUBLE + (CASE WHEN contains(text, '##') THEN 3 ELSE 0 END + CASE WHEN contains(text, '- ') OR contains(text, '* ') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '\\p{{Nd}}') THEN 2 ELSE 0 END) * 180) / 6000"
_add("summary_confidence", lambda s, d: M.summary_confidence(D.docs_aug(s, d), "text").select("doc_id", "summary_confidence"), f"WITH {DOCS} SELECT doc_id, CASE WHEN length(text) < 50 THEN 0.1 ELSE greatest(0.1, least(1.0, {_units})) END AS summary_confidence FROM docs_aug".replace("{{Nd}}", "{Nd}"))
_add("summary_stats", lambda s, d: M.summary_stats(D.docs_aug(s, d).join(M.keyword_lines(D.docs_aug(s, d)), "doc_id")).select("doc_id", "original_length", "summary_length", "original_words", "summary_words", "compression"), f"WITH {DOCS}, {_kw} SELECT doc_id, CAST(length(text) AS BIGINT) AS original_length, CAST(length(summary) AS BIGINT) AS summary_length, CAST(len({sql_words('text')}) AS BIGINT) AS original_words, CAST(len({sql_words('summary')}) AS BIGINT) AS summary_words, CASE WHEN length(text) > 0 THEN format('{{:,.1f}}', (length(text) - length(summary)) * 100 / CAST(length(text) AS DOUBLE)) ELSE '0.0' END AS compression FROM ks")
_supplied = lambda s, d: D.read(s, d, "documents").where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Summary of "), F.col("doc_id").cast("string"))).otherwise("  ").alias("summary"), (F.col("doc_id") % 9 != 0).alias("success"))
_add("summary_resolution", lambda s, d: M.resolve_summaries(D.docs_aug(s, d), _supplied(s, d)), f"WITH {DOCS}, {_kw}, g AS (SELECT *, doc_id % 6 = 0 AND doc_id % 9 <> 0 AS given, {strip('text')} = '' AS blank FROM ks) SELECT doc_id, CASE WHEN blank THEN 'No content to summarise.' WHEN given THEN 'Summary of ' || doc_id ELSE summary END AS summary, CASE WHEN blank THEN 'none' WHEN given THEN 'supplied' ELSE 'keywords' END AS method, NOT blank AS ok FROM g")


# ---- accounting
def _runs(s, d):
    e = D.read(s, d, "events")
    return e.select(F.floor(F.col("event_id") / 4).cast("long").alias("run_id"), (F.col("event_id") % 4).cast("long").alias("stage_no"), F.element_at(F.array(*[F.lit(x) for x in ("analyse", "extract", "format", "rate")]), (F.col("event_id") % 4 + 1).cast("int")).alias("stage"), (F.col("event_id") % 7 != 3).alias("success"), (F.col("event_id") * 37 % 5000).cast("long").alias("tokens"), (F.col("user_id") % 60).cast("long").alias("seconds"))


_rn = "rn AS (SELECT event_id // 4 AS run_id, event_id % 4 AS stage_no, ['analyse', 'extract', 'format', 'rate'][CAST(event_id % 4 AS INT) + 1] AS stage, event_id % 7 <> 3 AS success, event_id * 37 % 5000 AS tokens, CAST(user_id % 60 AS BIGINT) AS seconds FROM events)"
_add("token_cost", lambda s, d: A.token_cost(D.read(s, d, "events").select("event_id", (F.col("event_id") % 6).alias("calls"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("event_id") % 11000).alias("tokens"))).drop("calls", "tokens"), """WITH t AS (SELECT event_id, event_id % 6 AS c, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 11000 END AS t FROM events), f AS (SELECT event_id, CAST(c * 1500 AS BIGINT) AS vision_tokens, CAST(CASE WHEN t = 0 AND c > 0 THEN 2000 ELSE greatest(0, t - c * 1500) END AS BIGINT) AS formatting_tokens, CAST(CASE WHEN t = 0 AND c > 0 THEN c * 1500 + 2000 ELSE t END AS BIGINT) AS total_tokens FROM t) SELECT *, (vision_tokens + formatting_tokens) * 3 / 1000000.0::DOUBLE AS cost FROM f""")
_add("run_analytics", lambda s, d: A.run_analytics(_runs(s, d)), f"WITH {_rn}, g AS (SELECT run_id, count(*) AS stages, CAST(sum(tokens) AS BIGINT) AS tokens, max(tokens) AS most, CAST(sum(seconds) AS BIGINT) AS seconds, CAST(sum(CAST(success AS INT)) AS BIGINT) AS ok FROM rn GROUP BY run_id), h AS (SELECT run_id, string_agg(stage || ': ' || format('{{:.1f}}', CASE WHEN g.tokens > 0 THEN rn.tokens * 100 / CAST(g.tokens AS DOUBLE) ELSE 0 END::DOUBLE) || '% ' || rn.seconds || ' s', ', ' ORDER BY stage) AS parts FROM rn JOIN g USING (run_id) GROUP BY run_id) SELECT run_id, parts, stages, tokens, seconds, ok, tokens / CAST(stages AS DOUBLE) AS tokens_per_stage, seconds / CAST(stages AS DOUBLE) AS seconds_per_stage, CASE WHEN tokens > 0 THEN most * 100 / CAST(tokens AS DOUBLE) ELSE 0 END::DOUBLE AS top_share FROM g JOIN h USING (run_id)")


def _results(s, d):
    p = D.doc_pages(s, d).groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(word_count(F.col("text"))).alias("words"))
    k = F.col("doc_id")
    return p.select("doc_id", "pages", "words", (F.col("pages") % 4).alias("calls"), (k % 90).alias("seconds"), (k % 5 * 1500).alias("vision_tokens"), (k % 3 * 700).alias("formatting_tokens"), (k % 7 / 4).alias("extraction_seconds"), (k % 2 / 2).alias("report_seconds"), F.lit(0.0).alias("summary_seconds"))


_add("result_analytics", lambda s, d: A.result_analytics(_results(s, d)).select("doc_id", "words", "calls_per_page", "seconds_per_page", "vision_share", "formatting_share", "timings"), f"""WITH {PAGES}, p AS (SELECT doc_id, count(*) AS pages, CAST(sum(len({sql_words('text')})) AS BIGINT) AS words FROM doc_pages GROUP BY 1), t AS (SELECT *, doc_id % 5 * 1500 AS v, doc_id % 3 * 700 AS f, (doc_id % 7) / 4.0::DOUBLE AS x, (doc_id % 2) / 2.0::DOUBLE AS r FROM p)
SELECT doc_id, words, round((pages % 4) / CAST(pages AS DOUBLE), 1) AS calls_per_page, (doc_id % 90) / CAST(pages AS DOUBLE) AS seconds_per_page, CASE WHEN v + f > 0 THEN v * 100 / CAST(v + f AS DOUBLE) ELSE 0 END::DOUBLE AS vision_share, CASE WHEN v + f > 0 THEN f * 100 / CAST(v + f AS DOUBLE) ELSE 0 END::DOUBLE AS formatting_share, CASE WHEN x > 0 OR r > 0 THEN format('Extraction: {{:.2f}}s, Quality report: {{:.2f}}s, Summary: 0.00s', x, r) ELSE '' END AS timings FROM t""")
_add("stage_rollup", lambda s, d: A.stage_rollup(_runs(s, d)), f"WITH {_rn} SELECT stage, count(*) AS n, CAST(sum(CAST(success AS INT)) AS BIGINT) AS ok, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(seconds) AS BIGINT) AS seconds, sum(CAST(success AS INT)) * 100 / CAST(count(*) AS DOUBLE) AS rate FROM rn GROUP BY ROLLUP (stage)")
_add("stage_chain", lambda s, d: A.stage_chain(_runs(s, d)), f"WITH {_rn}, f AS (SELECT run_id, min(stage_no) FILTER (WHERE NOT success) AS bad FROM rn GROUP BY 1) SELECT rn.* FROM rn JOIN f USING (run_id) WHERE bad IS NULL OR stage_no <= bad")
_at = f"WITH {PAGES}, att AS (SELECT doc_id, page_no, CAST(a AS INT) AS attempt, (doc_id + page_no * 3 + a * 2) % 7 < 2 AS success, 'v' || a || ': ' || text AS content FROM doc_pages, range(1, 4) r(a)), o AS (SELECT doc_id, page_no, min(attempt) FILTER (WHERE success) AS attempt, arg_min(content, attempt) FILTER (WHERE success) AS content FROM att GROUP BY 1, 2)"
_error = "['Request timeout', 'Rate limit hit', 'Bad gateway'][CAST((doc_id + page_no) % 3 AS INT) + 1]"
_add("retry_outcome", lambda s, d: A.retry_outcome(D.attempts(D.doc_pages(s, d)), ["doc_id", "page_no"]), f"{_at} SELECT doc_id, page_no, attempt, content, attempt IS NOT NULL AS success, CASE WHEN attempt IS NULL THEN 'Max retries: ' || {_error} END AS error FROM o")
_add("error_classes", lambda s, d: D.attempts(D.doc_pages(s, d)).where("error is not null").groupBy(A.error_class(F.col("error")).alias("class")).agg(F.count("*").alias("n")), f"{_at} SELECT CASE (doc_id + page_no) % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'rate_limit' ELSE 'other' END AS class, count(*) AS n FROM att WHERE NOT success GROUP BY 1")
_add("truncated_replies", lambda s, d: D.read(s, d, "events").select("event_id", A.truncated(F.element_at(F.array(*[F.lit(x) for x in ("stop", "length", "max_tokens", None)]), (F.col("event_id") % 4 + 1).cast("int"))).alias("truncated")), "SELECT event_id, event_id % 4 IN (1, 2) AS truncated FROM events")
_agents = lambda s, d: D.read(s, d, "events").select("event_id", (F.col("user_id") % 5).cast("long").alias("agent_id"), "ts", F.col("event_type").alias("event"), (F.col("event_id") % 101).alias("hundredths"))
_add("last_n_events", lambda s, d: A.last_events(_agents(s, d), "agent_id", ["ts", "event_id"]).select("agent_id", "event_id", "age"), "WITH a AS (SELECT CAST(user_id % 5 AS BIGINT) AS agent_id, event_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts DESC, event_id DESC) AS age FROM events) SELECT * FROM a WHERE age <= 50")
_add("agent_confidence", lambda s, d: A.agent_confidence(_agents(s, d)), "SELECT CAST(user_id % 5 AS BIGINT) AS agent_id, count(*) AS entries, sum(event_id % 101) / CAST(count(*) AS DOUBLE) / 100 AS confidence FROM events GROUP BY 1")
_add("job_latest", lambda s, d: A.latest_jobs(D.read(s, d, "events").select("event_id", F.col("user_id").cast("long").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("updated_at"), (F.col("event_id") % 101).alias("progress"))).groupBy("status").agg(F.count("*").alias("jobs"), F.sum("progress").alias("progress")), "WITH j AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT event_type AS status, count(*) AS jobs, CAST(sum(event_id % 101) AS BIGINT) AS progress FROM j WHERE n = 1 GROUP BY 1")
_add("raw_capture", lambda s, d: A.raw_capture(D.doc_pages(s, d)), f"WITH {PAGES} SELECT doc_id, string_agg('Page ' || page_no || ' - standard extraction:' || chr(10) || text, chr(10) || repeat('=', 100) || chr(10) ORDER BY page_no) AS capture FROM doc_pages GROUP BY doc_id")

NOW = "2024-06-02 00:00:00"


def _cache_pages(s, d):
    return D.doc_pages(s, d).withColumn("key", A.cache_key(F.col("text"), F.lit("standard"), F.col("page_no"))).select("doc_id", "page_no", "key")


def _cache(s, d):
    k = _cache_pages(s, d).where("doc_id % 2 = 0").groupBy("key").agg(F.min("doc_id").alias("n"))
    return k.select("key", F.concat(F.lit("cached "), F.col("n").cast("string")).alias("payload"), F.element_at(F.array(*[F.lit(x).cast("timestamp") for x in ("2024-06-01 23:00:00", "2024-06-01 01:00:00", "2024-05-31 23:00:00")]), (F.col("n") % 3 + 1).cast("int")).alias("written_at"))


_ca = f"WITH {PAGES}, kp AS (SELECT doc_id, page_no, substr(sha256(text), 1, 16) || '_standard_' || page_no AS key FROM doc_pages), ca AS (SELECT key, min(doc_id) AS n FROM kp WHERE doc_id % 2 = 0 GROUP BY key)"
_add("cache_lookup", lambda s, d: A.cache_lookup(_cache_pages(s, d), _cache(s, d), NOW), f"{_ca} SELECT kp.doc_id, page_no, kp.key, CASE WHEN n IS NOT NULL THEN 'cached ' || n END AS payload, n IS NOT NULL AS hit FROM kp LEFT JOIN (SELECT * FROM ca WHERE n % 3 < 2) c USING (key)")
_fresh = lambda s, d: _cache_pages(s, d).where("doc_id % 4 = 0").groupBy("key").agg(F.max("doc_id").alias("n")).select("key", F.concat(F.lit("new "), F.col("n").cast("string")).alias("payload"), F.lit("2024-06-01 12:00:00").cast("timestamp").alias("written_at"))
_add("cache_upsert", lambda s, d: A.cache_upsert(_cache(s, d), _fresh(s, d)).select("key", "payload"), f"{_ca}, fr AS (SELECT key, max(doc_id) AS m FROM kp WHERE doc_id % 4 = 0 GROUP BY key) SELECT coalesce(ca.key, fr.key) AS key, CASE WHEN m IS NULL OR n % 3 = 0 THEN 'cached ' || n ELSE 'new ' || m END AS payload FROM ca FULL JOIN fr USING (key)")
