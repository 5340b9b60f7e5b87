"""Queries on worksheets and tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as P
from ..operators import sheets as X
from ..sources import derived as D
from .sql import DOCS, q, rlike

QUERIES, ORACLES = {}, {}


def _add(name, build, sql):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


_heads = ", ".join(f"('nation', {r}::BIGINT, {c}::BIGINT, {q(v) if v else 'NULL'})" for r, vs in D.HEADERS["nation"] for c, v in enumerate(vs, 1))
_list = lambda *x: "[" + ", ".join(x) + "]"
_unp = lambda sheet, row, values, source: f"SELECT {sheet} AS sheet, CAST({row} AS BIGINT) AS row, CAST(generate_subscripts({values}, 1) AS BIGINT) AS col, unnest({values}) AS value FROM {source}"
_nation = _list("CASE WHEN n_nationkey // 5 = 0 THEN r_name END", "n_name", "'$' || n_nationkey * 1000 || '.5'", "n_nationkey || '%'", "CASE WHEN n_nationkey % 3 = 0 THEN 'yes' ELSE 'no' END")
_part = _list("p_name", "p_brand", "CASE WHEN p_partkey % 4 <> 0 THEN p_type END", "CAST(p_size AS VARCHAR)", "'$' || p_size * 100 || '/lot'", "(p_partkey % 12 + 1) || '/' || (p_partkey % 28 + 1) || '/24'")
_supp = _list("s_name", "CAST(s_nationkey AS VARCHAR)", "CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey * 1250 ELSE 0 END AS VARCHAR)")
_of = lambda kind, key: f"'{kind}_' || {key} // {D.SHEET_ROWS}"


def _sheets(kind, key, values):
    titles = [_unp("sheet", row, _list(*map(q, vs)), f"(SELECT DISTINCT {_of(kind, key)} AS sheet FROM {kind})") for row, vs in D.HEADERS[kind]]
    return " UNION ALL ".join([_unp(_of(kind, key), f"{key} % {D.SHEET_ROWS} + 2", values, kind), *titles])


_cells = f"""WITH hd(sheet, row, col, value) AS (VALUES {_heads}), cells AS (SELECT * FROM hd UNION ALL {_unp("'nation'", 'n_regionkey * 5 + n_nationkey // 5 + 3', _nation, 'nation JOIN region ON n_regionkey = r_regionkey')} UNION ALL {_sheets('part', 'p_partkey', _part)} UNION ALL {_sheets('supplier', 's_suppkey', _supp)}),
mg(sheet, r0, c0, r1, c1) AS (VALUES {', '.join(f"({q(m[0])}, {', '.join(map(str, m[1:]))})" for m in D.MERGED)}),
fc AS (SELECT c.sheet, c.row, c.col, CASE WHEN m.sheet IS NULL THEN c.value ELSE t.value END AS value FROM cells c LEFT JOIN mg m ON m.sheet = c.sheet AND c.row BETWEEN r0 AND r1 AND c.col BETWEEN c0 AND c1 LEFT JOIN cells t ON t.sheet = m.sheet AND t.row = r0 AND t.col = c0)"""
_num = lambda x: rlike(f"trim(translate({x}, ',$%()', ''))", X.NUMBER)
_date = lambda x: "(" + " OR ".join(rlike(x, p) for p in X.DATES) + ")"
_v = "v AS (SELECT sheet, row, col, trim(coalesce(value, '')) AS v FROM fc)"
_hr = f"""{_cells}, {_v}, hr AS (SELECT sheet, row, count(*) FILTER (WHERE v <> '') AS n, count(*) FILTER (WHERE v <> '' AND ({_num('v')} OR contains(v, ':') OR contains(v, '%') OR lower(v) IN ('yes', 'no'))) AS d FROM v WHERE row <= 3 GROUP BY 1, 2),
hc AS (SELECT sheet, min(row) FILTER (WHERE row > 1 AND n > 0 AND d * 4 > n) AS cut FROM hr GROUP BY 1), hk AS (SELECT sheet, count(*) AS header_rows FROM hr JOIN hc USING (sheet) WHERE n > 0 AND (cut IS NULL OR row < cut) GROUP BY 1),
h AS (SELECT sheet, header_rows, coalesce(cut, header_rows + 1) AS data_start, header_rows > 1 AS multi_level FROM hc JOIN hk USING (sheet))"""
_nm = f"""{_hr}, ht AS (SELECT v.*, lag(v) OVER (PARTITION BY sheet, col ORDER BY row) AS b FROM v JOIN h USING (sheet) WHERE row < data_start AND v <> ''), hn AS (SELECT sheet, col, string_agg(v, ' - ' ORDER BY row) AS hd FROM ht WHERE b IS NULL OR b <> v GROUP BY 1, 2),
nm AS (SELECT c.sheet, c.col, coalesce(hd, 'Column' || c.col) AS header FROM (SELECT DISTINCT sheet, col FROM v) c LEFT JOIN hn ON hn.sheet = c.sheet AND hn.col = c.col),
cs AS (SELECT v.*, row_number() OVER (PARTITION BY sheet, col ORDER BY row) AS n FROM v JOIN h USING (sheet) WHERE row >= data_start AND v <> ''),
cg AS (SELECT sheet, col, count(*) AS n_samples, bool_and({_num('v')}) AS num, bool_and(contains(v, '$') OR {_num('v')}) AS cur, bool_and(contains(v, '%') OR ({_num("replace(v, '%', '')")} AND coalesce(TRY_CAST(replace(v, '%', '') AS DOUBLE) <= 100, false))) AS pct, count(*) FILTER (WHERE {_date('v')}) AS dates, max(length(v)) AS longest FROM cs WHERE n <= 5 GROUP BY 1, 2),
pf AS (SELECT sheet, col, n_samples, CASE WHEN num THEN 'numeric' WHEN cur THEN 'currency' WHEN pct THEN 'percentage' WHEN dates * 2 > n_samples THEN 'date' ELSE 'text' END AS type, longest FROM cg),
pr AS (SELECT sheet, col, n_samples, type, CASE WHEN type = 'text' AND longest < 100 AND col <= 5 THEN 'label_' || col ELSE 'data' END AS role FROM pf)"""


class _Book:
    """The derived workbook with its headers, names and profiles."""

    def __init__(self, s, d):
        # each part is used several times
        self.cells = X.merged_fill(D.cells(s, d), D.merged(s)).persist()
        self.headers = X.header_rows(self.cells).persist()
        self.names = X.header_names(self.cells, self.headers).persist()
        self.profiles = X.column_profiles(self.cells, self.headers).persist()

    def lines(self):
        return X.label_unpivot(self.cells, self.headers, self.names, self.profiles)


_add("merged_fill", lambda s, d: X.merged_fill(D.cells(s, d), D.merged(s)), f"{_cells} SELECT * FROM fc")
_add("header_rows", lambda s, d: _Book(s, d).headers, f"{_hr} SELECT * FROM h")
_add("header_rows_legacy", lambda s, d: X.header_rows_legacy(_Book(s, d).cells), f"{_cells}, {_v}, w AS (SELECT sheet, row, max(col) AS w, count(*) FILTER (WHERE v <> '' AND NOT {_num('v')}) AS t FROM v WHERE row <= 10 GROUP BY 1, 2) SELECT sheet, CAST(coalesce(min(row) FILTER (WHERE t * 2 <= w) - 1, max(row)) AS BIGINT) AS header_rows FROM w GROUP BY 1")
_add("header_names", lambda s, d: _Book(s, d).names, f"{_nm} SELECT * FROM nm")
_add("column_types", lambda s, d: _Book(s, d).profiles.select("sheet", "col", "n_samples", "type"), f"{_nm} SELECT sheet, col, n_samples, type FROM pr")
_add("column_roles", lambda s, d: _Book(s, d).profiles.select("sheet", "col", "role"), f"{_nm} SELECT sheet, col, role FROM pr")
_add("structure_confidence", lambda s, d: X.structure_confidence((b := _Book(s, d)).headers, b.profiles), f"{_nm} SELECT sheet, (5 + CASE WHEN header_rows > 0 THEN 2 ELSE 0 END + 3) / 10.0::DOUBLE AS confidence FROM h")
_add("hierarchy_flag", lambda s, d: X.hierarchy_flag(D.cells(s, d), X.header_rows(D.cells(s, d))), _hr.replace("FROM fc)", "FROM cells)") + ", f AS (SELECT v.* FROM v JOIN h USING (sheet) WHERE col = 1 AND row BETWEEN data_start AND data_start + 9) SELECT sheet, count(*) FILTER (WHERE v <> '') AS filled, count(*) AS rows, count(*) FILTER (WHERE v <> '') * 10 < count(*) * 7 AS hierarchical, count(DISTINCT CASE WHEN v <> '' THEN v END) * 2 < count(*) AS repeats FROM f GROUP BY 1")


def _values(s, d):
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("event_id") % len(v) + 1).cast("int"))
    n = (F.col("event_id") * 37 % 100000).cast("string")
    e = D.read(s, d, "events")
    value = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("$"), n, F.lit(".5"))).when(F.col("event_id") % 7 == 1, F.concat(n, F.lit("%"))).when(F.col("event_id") % 7 == 2, F.concat(F.lit("-"), n)).when(F.col("event_id") % 7 == 3, F.concat(n, F.lit(".125"))).when(F.col("event_id") % 7 == 4, F.concat(F.lit("("), n, F.lit(")"))).when(F.col("event_id") % 7 == 5, F.concat(n, F.lit(" visits"))).otherwise(F.concat(F.lit("0.0"), F.col("event_id") % 9))
    return e.select("event_id", value.alias("value"), pick("numeric", "text", "percentage", "currency").alias("kind"))


_n = "(event_id * 37 % 100000)"
_vals = f"WITH e AS (SELECT event_id, ['numeric', 'text', 'percentage', 'currency'][CAST(event_id % 4 AS INT) + 1] AS kind, event_id % 7 AS m, {_n} AS n, CASE event_id % 7 WHEN 0 THEN '$' || {_n} || '.5' WHEN 1 THEN {_n} || '%' WHEN 2 THEN '-' || {_n} WHEN 3 THEN {_n} || '.125' WHEN 4 THEN '(' || {_n} || ')' WHEN 5 THEN {_n} || ' visits' ELSE '0.0' || event_id % 9 END AS value FROM events), p AS (SELECT *, TRY_CAST(value AS DOUBLE) AS x FROM e)"
_add("format_values", lambda s, d: _values(s, d).select("event_id", X.format_value(F.col("value"), F.col("kind")).alias("shown")), f"""{_vals} SELECT event_id, CASE WHEN m = 0 THEN '$' || format('{{:,.2f}}', n + 0.5::DOUBLE) WHEN kind = 'currency' THEN CASE WHEN x IS NULL THEN value WHEN x >= 0 THEN '$' || format('{{:,.2f}}', x) ELSE '-$' || format('{{:,.2f}}', -x) END
WHEN m = 1 THEN format('{{:,.2f}}', CAST(n AS DOUBLE)) || '%' WHEN kind = 'percentage' THEN CASE WHEN x IS NULL THEN value ELSE format('{{:,.2f}}', x * 100) || '%' END WHEN x IS NULL THEN value WHEN x = floor(x) THEN format('{{:,}}', CAST(x AS BIGINT)) WHEN m = 3 THEN format('{{:,}}', n) || '.125' ELSE value END AS shown FROM p""")
_add("value_predicates", lambda s, d: D.cells(s, d).select("sheet", "row", "col", X.is_numeric(X.value_of()).alias("numeric"), X.is_date(X.value_of()).alias("date"), X.is_category(X.value_of()).alias("category")), f"{_cells}, w AS (SELECT sheet, row, col, trim(coalesce(value, '')) AS v FROM cells) SELECT sheet, row, col, {_num('v')} AS numeric, {_date('v')} AS date, v <> '' AND length(v) <= 50 AND NOT {_num('v')} AND len(string_split_regex(v, '\\s+')) <= 5 AND NOT regexp_matches(v, '^[0-9]{{2,4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,4}}$') AND NOT regexp_matches(v, '^[0-9]{{5,}}$') AS category FROM w".replace("{{", "{").replace("}}", "}"))
_fmtv = "CASE WHEN type = 'currency' OR contains(c.v, '$') THEN CASE WHEN contains(c.v, '/') THEN c.v ELSE '$' || format('{:,.2f}', CAST(replace(c.v, '$', '') AS DOUBLE)) END WHEN contains(c.v, '%') THEN format('{:,.2f}', CAST(replace(c.v, '%', '') AS DOUBLE)) || '%' WHEN TRY_CAST(c.v AS BIGINT) IS NOT NULL THEN format('{:,}', CAST(c.v AS BIGINT)) ELSE c.v END"
_ln = f"""{_nm}, lb AS (SELECT sheet, row, string_agg(v, ' - ' ORDER BY col) AS labels FROM cs JOIN pr USING (sheet, col) WHERE starts_with(role, 'label') GROUP BY 1, 2),
ln AS (SELECT c.sheet, c.row, c.col, '- ' || labels || ' - ' || header || ' = ' || {_fmtv} AS line FROM cs c JOIN pr USING (sheet, col) JOIN lb USING (sheet, row) JOIN nm USING (sheet, col) WHERE role = 'data')"""
_add("label_unpivot", lambda s, d: _Book(s, d).lines(), f"{_ln} SELECT * FROM ln")
_add("hierarchical_rows", lambda s, d: X.hierarchical_rows(D.cells(s, d), X.header_rows(D.cells(s, d)), X.header_names(D.cells(s, d), X.header_rows(D.cells(s, d)))), _nm.replace("FROM fc)", "FROM cells)") + """, ky AS (SELECT sheet, row, max(nullif(v, '')) FILTER (WHERE col = 1) AS c, max(nullif(v, '')) FILTER (WHERE col = 2) AS sub FROM v JOIN h USING (sheet) WHERE row >= data_start GROUP BY 1, 2),
kd AS (SELECT *, concat_ws(': ', last_value(c IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row ROWS UNBOUNDED PRECEDING), sub) AS id FROM ky) SELECT v.sheet, v.row, v.col, '- ' || id || ' - ' || header || ' = ' || v.v AS line FROM v JOIN kd USING (sheet, row) JOIN nm USING (sheet, col) WHERE v.col > 2 AND v.v NOT IN ('', '0', '0.0', 'nan') AND id <> ''""")
_add("flat_rows", lambda s, d: X.flat_rows((b := _Book(s, d)).cells, b.headers, b.names, b.profiles), f"{_nm}, i AS (SELECT cs.sheet, row, v AS id FROM cs JOIN pr USING (sheet, col) WHERE col = 1 AND type = 'text') SELECT c.sheet, c.row, c.col, '- ' || coalesce(id || ' - ', '') || header || ': ' || c.v AS line FROM cs c LEFT JOIN i USING (sheet, row) JOIN nm USING (sheet, col) WHERE id IS NULL OR c.col > 1")
_gk = "CASE WHEN starts_with(line, '- ') THEN array_to_string(list_slice(string_split(CASE WHEN contains(line, ' = ') THEN split_part(substr(line, 3), ' = ', 1) ELSE split_part(substr(line, 3), ': ', 1) END, ' - '), 1, 3), ' - ') ELSE 'misc' END"
_add("group_keys", lambda s, d: _Book(s, d).lines().select("sheet", "row", "col", X.group_key(F.col("line")).alias("key")), f"{_ln} SELECT sheet, row, col, {_gk} AS key FROM ln")
_add("sections", lambda s, d: X.sections(_Book(s, d).lines().withColumn("line", F.concat(F.lit("- "), "sheet", F.lit(" = "), "line"))).select("sheet", "row", "col", "section", "part"), f"{_ln}, g AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY row, col) AS n FROM ln) SELECT sheet, row, col, 1::BIGINT AS section, CASE WHEN n <= 19 THEN 1 ELSE (n - 1 + 17) // 18 END AS part FROM g")
_add("section_titles", lambda s, d: X.sections(_Book(s, d).lines()).select("sheet", "row", "col", "section", "part", F.length("title").cast("long").alias("title_length")), f"""{_ln}, g AS (SELECT *, {_gk} AS key FROM ln), l AS (SELECT *, lag(key) OVER (PARTITION BY sheet ORDER BY row, col) AS b FROM g), t AS (SELECT *, CAST(sum(CASE WHEN b IS NULL OR b <> key THEN 1 ELSE 0 END) OVER (PARTITION BY sheet ORDER BY row, col) AS BIGINT) AS section FROM l),
u AS (SELECT *, row_number() OVER (PARTITION BY sheet, section ORDER BY row, col) AS n, count(*) OVER (PARTITION BY sheet, section) AS al, CAST(section = 1 AS INT) AS f FROM t), w AS (SELECT *, CASE WHEN n <= 18 + f THEN 1 ELSE (n - f + 17) // 18 END AS part, CASE WHEN al <= 18 + f THEN 1 ELSE (al - f + 17) // 18 END AS parts FROM u)
SELECT sheet, row, col, section, part, CAST(length(key) + CASE WHEN parts > 1 THEN length(' (Part ' || part || ')') ELSE 0 END AS BIGINT) AS title_length FROM w""")


def _config(s):
    return s.createDataFrame([("supplier_0", 1, 1), ("nation", 2, 1), ("nation", 3, 2), ("empty", 2, 1)], "sheet string, ordinal int, saved int")


_add("sheet_union", lambda s, d: X.sheet_union(_Book(s, d).lines(), _config(s)), f"{_ln}, cf(sheet, ordinal) AS (VALUES ('supplier_0', 1), ('nation', 3), ('empty', 2)) SELECT ordinal, sheet, 0::BIGINT AS row, 0::BIGINT AS col, '## ' || sheet AS line FROM cf UNION ALL SELECT ordinal, cf.sheet, coalesce(row, 1), coalesce(col, 1), coalesce(line, '*[Failed to process sheet ' || cf.sheet || ']*') FROM cf LEFT JOIN ln ON ln.sheet = cf.sheet")
_add("workbook_stats", lambda s, d: X.workbook_stats((b := _Book(s, d)).cells, b.lines()), f"{_ln}, c AS (SELECT sheet, max(col) AS cols, count(*) FILTER (WHERE v <> '') AS filled FROM v GROUP BY 1), n AS (SELECT sheet, count(*) AS lines, sum(length(line)) AS chars FROM ln GROUP BY 1) SELECT count(*) AS sheets, max(cols) AS max_columns, CAST(sum(filled) AS BIGINT) AS filled, CAST(sum(coalesce(lines, 0)) AS BIGINT) AS lines, sum(5 + CASE WHEN chars > 100 THEN 2 ELSE 0 END + CASE WHEN lines > 0 THEN 3 ELSE 0 END) / CAST(count(*) AS DOUBLE) / 10 AS confidence FROM c LEFT JOIN n USING (sheet)")
_add("sheet_document", lambda s, d: X.sheet_documents(_Book(s, d).lines(), D.workbooks(s, d), "Workbook", "2024-06-01 00:00:00"), f"{_ln}, k AS (SELECT DISTINCT p_partkey // {D.SHEET_ROWS} AS k FROM part), sh AS (SELECT 'w' || k AS workbook, 'nation' AS sheet, 1 AS ordinal FROM k UNION ALL SELECT 'w' || k, 'part_' || k, 2 FROM k UNION ALL SELECT 'w' || k, 'blank', 3 FROM k), b AS (SELECT sheet, string_agg(line, chr(10) ORDER BY row, col) AS body FROM ln GROUP BY 1) SELECT workbook, '# Workbook' || chr(10) || chr(10) || 'Processed: 2024-06-01 00:00:00' || chr(10) || 'Sheets: ' || count(*) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg('## Sheet: ' || sh.sheet || chr(10) || chr(10) || coalesce(body, '- *[No data in this sheet]*'), chr(10) || chr(10) ORDER BY ordinal) AS text FROM sh LEFT JOIN b ON b.sheet = sh.sheet GROUP BY workbook")
_add("sheet_document_blocks", lambda s, d: X.sheet_document_blocks(_Book(s, d).lines(), D.workbooks(s, d), "Workbook", "2024-06-01 00:00:00", 2048), f"""{_ln}, k AS (SELECT DISTINCT p_partkey // {D.SHEET_ROWS} AS k FROM part), sh AS (SELECT 'w' || k AS workbook, 'nation' AS sheet, 1 AS ordinal FROM k UNION ALL SELECT 'w' || k, 'part_' || k, 2 FROM k UNION ALL SELECT 'w' || k, 'blank', 3 FROM k),
pc AS (SELECT workbook, 0 AS ordinal, -2 AS row, 0 AS col, '# Workbook' || chr(10) || chr(10) || 'Processed: 2024-06-01 00:00:00' || chr(10) || 'Sheets: ' || count(*) || chr(10) || chr(10) || '---' AS t FROM sh GROUP BY 1 UNION ALL SELECT workbook, ordinal, -2, 0, chr(10) || chr(10) || '## Sheet: ' || sheet || chr(10) FROM sh UNION ALL SELECT workbook, ordinal, coalesce(row, -1), coalesce(col, 0), chr(10) || coalesce(line, '- *[No data in this sheet]*') FROM sh LEFT JOIN ln ON ln.sheet = sh.sheet),
st AS (SELECT *, CAST(sum(strlen(t)) OVER (PARTITION BY workbook ORDER BY ordinal, row, col, t) - strlen(t) AS BIGINT) AS s FROM pc) SELECT workbook, s // 1024 AS block, min(s) AS start, string_agg(t, '' ORDER BY s) AS text FROM st GROUP BY 1, 2""")
_add("content_confidence", lambda s, d: D.docs_aug(s, d).select("doc_id", X.content_confidence(F.col("text")).alias("content"), X.formatting_confidence(F.col("text"), F.when(F.col("doc_id") % 2 == 0, True)).alias("formatting")), f"WITH {DOCS} SELECT doc_id, greatest(10, least(100, 90 - CASE WHEN length(text) < 100 THEN 30 WHEN length(text) < 500 THEN 10 ELSE 0 END + CASE WHEN contains(text, '- **') THEN 5 ELSE 0 END + CASE WHEN contains(text, '## Sheet:') THEN 5 ELSE 0 END - CASE WHEN regexp_matches(text, '\\p{{Nd}}') THEN 0 ELSE 20 END)) / 100.0::DOUBLE AS content, least(10, 5 + CASE WHEN length(text) > 100 THEN 2 ELSE 0 END + CASE WHEN contains(text, ' - ') AND contains(text, ' = ') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '(?m)^[\\t ]*- ') THEN 1 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) / 10.0::DOUBLE AS formatting FROM docs_aug")
_books = lambda s, d: D.read(s, d, "orders").groupBy((F.col("o_custkey")).alias("workbook"), F.col("o_orderpriority").alias("sheet")).agg(F.sum((F.col("o_orderkey") % 3 == 0).cast("long")).alias("rows")).withColumn("chars", F.col("rows") * 40)
_add("workbook_confidence", lambda s, d: X.workbook_confidence(_books(s, d)).select(F.col("workbook").cast("long").alias("workbook"), "confidence"), "WITH b AS (SELECT o_custkey, o_orderpriority, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS n FROM orders GROUP BY 1, 2), w AS (SELECT o_custkey, count(*) AS s, count(*) FILTER (WHERE n = 0) AS e, sum(n) AS r FROM b GROUP BY 1) SELECT CAST(o_custkey AS BIGINT) AS workbook, CASE WHEN r = 0 THEN 0.1 ELSE round(greatest(0, 0.9::DOUBLE - (e * 3 / CAST(s * 10 AS DOUBLE) + CASE WHEN r * 40 < 100 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN r < 5 THEN 0.2 ELSE 0 END::DOUBLE)), 6) END::DOUBLE AS confidence FROM w")
_add("sheet_preview", lambda s, d: X.preview(D.cells(s, d), "part_0"), f"{_cells} SELECT * FROM cells WHERE sheet = 'part_0' AND row <= 10")
_CUST = ["c_name", "c_nationkey", "c_mktsegment"]
_wide = lambda s, d: D.read(s, d, "customer").select(F.col("c_custkey").alias("n"), "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey").cast("string")).alias("c_nationkey"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("  "), "c_mktsegment")).alias("c_mktsegment"))
_w = "WITH w AS (SELECT c_custkey AS n, c_name, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS c_nationkey, CASE WHEN c_custkey % 5 <> 0 THEN '  ' || c_mktsegment END AS c_mktsegment FROM customer)"
_add("row_listing", lambda s, d: X.row_listing(_wide(s, d), "n", _CUST), f"{_w} SELECT n, concat_ws(chr(10), '- **Row ' || n || '**', '  - **c_name**: ' || c_name, '  - **c_nationkey**: ' || c_nationkey, '  - **c_mktsegment**: ' || trim(c_mktsegment)) AS text FROM w")
_add("markdown_table", lambda s, d: X.pipe_rows(_wide(s, d).withColumn("n", F.col("n") + 1), "n", _CUST), f"{_w} SELECT n + 2 AS n, '| ' || c_name || ' | ' || coalesce(c_nationkey, '') || ' | ' || coalesce(trim(c_mktsegment), '') || ' |' AS line FROM w UNION ALL SELECT 0, '| c_name | c_nationkey | c_mktsegment |' UNION ALL SELECT 1, '|---|---|---|'")
_add("clean_table", lambda s, d: P.clean_table(_wide(s, d).select(F.when(F.col("n") % 15 != 0, F.col("c_name")).alias(" c_name "), "c_nationkey", "c_mktsegment")), f"{_w} SELECT CASE WHEN n % 15 <> 0 THEN c_name ELSE '' END AS c_name, coalesce(c_nationkey, '') AS c_nationkey, coalesce(trim(c_mktsegment), '') AS c_mktsegment FROM w WHERE NOT (n % 15 = 0)")
_add("clean_column_names", lambda s, d: D.read(s, d, "part").select("p_partkey", X.clean_column_name(F.concat(F.translate("p_name", " ", "_"), F.lit("_ID_"), "p_type", F.lit(" Unnamed"))).alias("name")), "SELECT p_partkey, array_to_string(list_transform(string_split(p_name || ' ID ' || p_type || ' Value', ' '), lambda w: CASE WHEN w = upper(w) AND length(w) <= 4 THEN w ELSE upper(w[1]) || lower(substr(w, 2)) END), ' ') AS name FROM part")
_add("table_profile", lambda s, d: X.table_profile(_wide(s, d), "n", _CUST), f"""{_w}, l AS (SELECT n, 0::BIGINT AS idx, 'c_name' AS name, c_name AS v FROM w UNION ALL SELECT n, 1, 'c_nationkey', coalesce(c_nationkey, '') FROM w UNION ALL SELECT n, 2, 'c_mktsegment', coalesce(trim(c_mktsegment), '') FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY idx, v <> '' ORDER BY n) AS k FROM l) SELECT idx, name, CASE WHEN idx = 1 THEN 'numeric' ELSE 'text' END AS type, count(*) FILTER (WHERE v <> '') AS filled, count(*) AS total, string_agg(v, ', ' ORDER BY n) FILTER (WHERE v <> '' AND k <= 5) AS samples, ['category', 'subcategory', 'data'][CAST(idx AS INT) + 1] AS part FROM r GROUP BY idx, name""")
