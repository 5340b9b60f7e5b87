"""Queries on stored tables and files: mixed intake, document files, the persistent cache, exactly-once sinks; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import derived as D
from ..sources import files as S
from ..sources import intake as I
from ..sources.cache_table import CacheTable
from ..sources.document_files import FOLDERS, list_document_files, read_document_files, write_document_files
from ..sources.workbooks import workbook_of
from ..streaming import jobs as J
from ..streaming import sinks as K
from .sql import DOCS
from .stream_queries import ORACLES as STREAMS
from .stream_queries import _name, _named

QUERIES, ORACLES = {}, {}


def _add(name, build, sql):
    QUERIES[name] = build
    ORACLES[name] = sql


def _markdown(s, d):
    """Every document as a file of its own, read back by name."""
    path = S.shared_folder(s)
    write_document_files(_named(s, d), path, folders=FOLDERS)
    return read_document_files(list_document_files(s, path, FOLDERS), path, FOLDERS).select("output_name", F.md5("content").alias("digest"))


_add("write_markdown", _markdown, f"WITH {DOCS} SELECT {_name} AS output_name, md5(text) AS digest FROM docs_aug")


def _intake(s, d):
    """Nations as files of their own, asked for by name with one more that is missing for each region."""
    path, n = S.shared_folder(s), D.read(s, d, "nation")
    name = F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, ".md").otherwise(".txt"))
    write_document_files(n.select(name.alias("output_name"), F.concat(F.lit("Notes on "), "n_name", F.lit("\nRegion "), F.col("n_regionkey").cast("string")).alias("content")), path)
    asked = n.select(name.alias("name")).unionByName(D.read(s, d, "region").select(F.concat(F.lit("lost_"), F.col("r_regionkey").cast("string"), F.lit(".md")).alias("name")))
    return I.intake(asked, path).select("name", "success", "error", "size", "content")


_add("file_intake", _intake, """WITH f AS (SELECT 'nation_' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.md' ELSE '.txt' END AS name, n_nationkey AS k, 'Notes on ' || n_name || chr(10) || 'Region ' || n_regionkey AS t FROM nation)
SELECT name, true AS success, NULL::VARCHAR AS error, CAST(strlen(t) AS BIGINT) AS size, CASE WHEN k % 2 = 0 THEN t ELSE '# Nation ' || k || chr(10) || chr(10) || t END AS content FROM f UNION ALL SELECT 'lost_' || r_regionkey || '.md', false, 'File not found: lost_' || r_regionkey || '.md', NULL, NULL FROM region""")


def _mixed_folder(s, d, path):
    """Files of five kinds, from tables: customers as text, Markdown, CSV, workbooks and paged files by their key modulo 16, some of
    each damaged or empty; and the requested names, one in 16 of them missing."""
    k, c = F.col("c_custkey"), D.read(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    m = k % 16
    suffix = F.element_at(F.array(*map(F.lit, (".txt", ".md", ".TXT", ".csv", ".csv", ".csv", ".csv", ".pdf", ".pdf", ".bin", ".md", ".xlsx", ".xlsx", ".xlsx", ".txt", ".md"))), m.cast("int") + 1)
    rows = c.select(F.concat(F.lit("note_"), k.cast("string"), suffix).alias("name"), m.cast("int").alias("m"), k.alias("k"), "c_name", "c_mktsegment", "c_nationkey")
    text = F.concat(F.lit("About "), "c_name", F.lit("\nSegment "), F.coalesce("c_mktsegment", F.lit("")))
    table = F.concat(F.lit("name,segment,say\n"), "c_name", F.lit(","), "c_mktsegment", F.lit(',"a ""b"", c"\n'), "c_name", F.lit(",,\n"))
    pages = F.concat(F.lit("%PDF-1.4\n"), F.repeat(F.lit("<< /Type /Page >>\n"), F.col("c_nationkey").cast("int") + 1), F.lit("<< /Type /Pages >>\n"))
    open_quote = F.concat(F.lit('name,say\nx,"'), "c_name", F.lit("\n"))
    data = F.when(F.col("m").isin(0, 1), text).when(F.col("m") == 2, "").when(F.col("m") == 3, table).when(F.col("m") == 4, open_quote).when(F.col("m") == 5, "").when(F.col("m") == 6, table).when(F.col("m") == 7, pages).when(F.col("m") == 8, "no pages").when(F.col("m") == 9, "?").when(F.col("m") == 12, "no workbook").otherwise(text).cast("binary")
    # two bytes that are no UTF-8 end these
    data = F.when(F.col("m").isin(6, 10), F.concat(data, F.unhex(F.lit("C328")))).otherwise(data)
    plain = rows.withColumn("data", data)

    def books(batches):
        import pyarrow as pa

        for batch in batches:
            made = [workbook_of([("Main", [["name", "", "nation"], [r["c_name"], r["c_mktsegment"] or "", str(r["c_nationkey"])], [], ["", "x<&>", ""]]), ("Blank & more", [])] if r["m"] == 11 else [("Only", [])]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["name", "data"])

    workbooks = rows.where("m in (11, 13)").mapInArrow(books, "name string, data binary")
    files = plain.where("m not in (11, 13, 15)").select("name", "data").unionByName(workbooks)
    write_document_files(files.select(F.col("name").alias("output_name"), F.col("data").alias("content")), path, folders=FOLDERS)
    return rows.select("name")


def _mixed(s, d):
    path = S.shared_folder(s)
    return I.intake(_mixed_folder(s, d, path), path, FOLDERS).drop("size")


_add("mixed_intake", _mixed, r"""WITH r AS (SELECT c_custkey AS k, c_custkey % 16 AS m, c_name AS n, coalesce(c_mktsegment, '') AS g, c_nationkey AS x, ['.txt', '.md', '.TXT', '.csv', '.csv', '.csv', '.csv', '.pdf', '.pdf', '.bin', '.md', '.xlsx', '.xlsx', '.xlsx', '.txt', '.md'][c_custkey % 16 + 1] AS suffix FROM customer),
f AS (SELECT *, 'note_' || k || suffix AS name, 'About ' || n || chr(10) || 'Segment ' || g AS t FROM r)
SELECT name, CASE WHEN m IN (3, 4, 5, 6, 11, 12, 13) THEN 'sheet' WHEN m IN (7, 8) THEN 'paged' WHEN m = 9 THEN 'unsupported' ELSE 'text' END AS kind,
m IN (0, 1, 2, 3, 7, 11, 14) AS success, CASE WHEN m = 4 THEN 'Open quote in line 2' WHEN m IN (5, 13) THEN 'No columns to parse from file' WHEN m IN (6, 10) THEN 'Invalid UTF-8' WHEN m = 8 THEN 'Invalid paged file' WHEN m = 9 THEN 'Unsupported file type: bin' WHEN m = 12 THEN 'Invalid workbook: BadZipFile' WHEN m = 15 THEN 'File not found: ' || name END AS error,
CASE WHEN m IN (0, 1, 2, 3, 14) THEN 1 WHEN m = 7 THEN x + 1 WHEN m = 11 THEN 2 ELSE 0 END::BIGINT AS parts,
CASE WHEN m IN (0, 14) THEN '# Note ' || k || chr(10) || chr(10) || t WHEN m = 1 THEN t WHEN m = 2 THEN '# Note ' || k || chr(10) || chr(10)
WHEN m = 3 THEN '- **Row 1**' || chr(10) || '  - **name**: ' || n || chr(10) || CASE WHEN g <> '' THEN '  - **segment**: ' || g || chr(10) ELSE '' END || '  - **say**: a "b", c' || chr(10) || '- **Row 2**' || chr(10) || '  - **name**: ' || n
WHEN m = 11 THEN '## Sheet: Main' || chr(10) || chr(10) || '- **Row 1**' || chr(10) || '  - **name**: ' || n || chr(10) || CASE WHEN g <> '' THEN '  - **Value 2**: ' || g || chr(10) ELSE '' END || '  - **nation**: ' || x || chr(10) || '- **Row 2**' || chr(10) || '- **Row 3**' || chr(10) || '  - **Value 2**: x<&>' || chr(10) || chr(10) || '## Sheet: Blank & more' || chr(10) || chr(10) || '- *[No data in this sheet]*' END AS content FROM f""")


def _stored(s, d):
    """Three upserts of documents by the hash of their text, the second an hour and the third 30 hours later, and a lookup from
    disk in the 40th hour: equal texts share an entry."""
    cache = CacheTable(s, S.shared_folder(s), buckets=16)
    docs = D.docs_aug(s, d).withColumn("key", F.sha2("text", 256))
    for hours, third in ((0, 0), (1, 1), (30, 2)):
        cache.upsert(docs.where(F.col("doc_id") % 3 == third).select("key", F.concat(F.lit(f"{third}: "), F.length("text").cast("string")).alias("payload"), F.timestamp_seconds(F.lit(1717243200 + 3600 * hours)).alias("written_at")))
    found = cache.lookup(docs.select("doc_id", "key"), "2024-06-03 04:00:00", 86_400)
    return found.select("doc_id", "payload", "hit")


_add("cache_store", _stored, f"WITH {DOCS}, c AS (SELECT text, bool_or(doc_id % 3 = 2) AS hit FROM docs_aug GROUP BY text) SELECT doc_id, CASE WHEN hit THEN '2: ' || length(d.text) END AS payload, hit FROM docs_aug d JOIN c USING (text)")


def _scored_log(s, d):
    """Documents arrive in two lots; each batch appends its scores and its log at once, and the job goes on from its checkpoint."""
    rows, path = D.read(s, d, "documents"), S.shared_folder(s)
    tables = K.BatchTables(s, S.shared_folder(s))
    for lot in (0, 1):
        rows.where(F.col("doc_id") % 2 == lot).write.mode("append").parquet(path)
        K.drain(K.scored_intake(s.readStream.schema(rows.schema).parquet(path)), tables, K.with_log)
    log = tables.read("log", "level string, message string").select("level", "message")
    scored = tables.read("scored", "doc_id long, total_score double, use_vision boolean, reason string")
    counts = scored.groupBy("use_vision").count().select(F.lit("scored").alias("level"), F.concat(F.when(F.col("use_vision"), "vision ").otherwise("text "), F.col("count").cast("string")).alias("message"))
    return log.unionByName(counts)


_intake_sql = STREAMS["stream_intake"]
_add("stream_scored_log", _scored_log, f"""WITH si AS MATERIALIZED ({_intake_sql}) SELECT 'info' AS level, '[' || strftime(TIMESTAMP '1970-01-01' + doc_id * INTERVAL 1 SECOND, '%H:%M:%S') || '] page ' || doc_id || ' via ' || CASE WHEN use_vision THEN 'vision' ELSE 'text' END || ' in 0 s' AS message FROM si
UNION ALL SELECT 'scored', CASE WHEN use_vision THEN 'vision ' ELSE 'text ' END || count(*) FROM si GROUP BY use_vision""")


def _late(s, d):
    """Metrics of hours, fed in three files: the earliest third of the events comes last, when the watermark has passed most of
    it. What is given out, and how many rows were read and dropped for lateness, batch by batch."""
    events, path = D.read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), S.shared_folder(s)
    first, last = events.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    third = F.least(F.lit(2), F.floor((F.unix_micros("ts") - F.lit(first or 0)) * 3 / F.lit(max(1, (last or 0) - (first or 0)))))
    tables = K.BatchTables(s, S.shared_folder(s))
    for part in (1, 2, 0):
        events.where(third == part).coalesce(1).write.mode("append").parquet(path)
        K.drain(J.window_metrics(s.readStream.schema(events.schema).parquet(path)), tables, lambda rows: {"metrics": rows})
    out = tables.read("metrics", "start timestamp_ntz, event_type string, n long, points long")
    told = K.progress(tables).where("rows_in > 0 or late_rows > 0")
    return out.selectExpr("cast(start as string) as what", "event_type as kind", "n").unionByName(told.agg(F.sum("rows_in").alias("n"), F.sum("late_rows").alias("late")).selectExpr("stack(2, 'rows in', n, 'late', late) as (what, n)").selectExpr("what", "'' as kind", "n"))


_add("stream_late_rows", _late, """WITH b AS (SELECT min(epoch_us(ts)) AS lo, greatest(1, max(epoch_us(ts)) - min(epoch_us(ts))) AS span, max(ts) - INTERVAL 10 MINUTE AS mark FROM events), e AS (SELECT ts, event_type, least(2, (epoch_us(ts) - lo) * 3 // span) AS part, mark FROM events, b),
w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, part, mark FROM e), l AS (SELECT *, part = 0 AND start + INTERVAL 1 HOUR <= mark AS late FROM w)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS what, event_type AS kind, count(*) AS n FROM l WHERE NOT late AND start + INTERVAL 1 HOUR <= mark GROUP BY 1, 2
UNION ALL SELECT 'rows in', '', count(*) FROM l UNION ALL SELECT 'late', '', count(DISTINCT (start, event_type)) FROM l WHERE late""")


def _log(s, d):
    """The log of page events, appended in two batches of which the second comes twice."""
    tables = K.BatchTables(s, S.shared_folder(s))
    pages = D.read(s, d, "events").select("ts", F.col("event_id").alias("page_no"), F.col("event_type").alias("method"), F.col("user_id").cast("long").alias("seconds"), (F.col("event_id") % 4 == 0).alias("from_cache"))
    for batch, half in ((0, 0), (1, 1), (1, 1)):
        tables.append(batch, {"log": S.page_log(pages.where(F.col("page_no") % 2 == half))})
    return tables.read("log", "ts timestamp_ntz, level string, message string").select("level", "message")


_add("processing_log", _log, "SELECT CASE WHEN user_id > 50 THEN 'warning' ELSE 'info' END AS level, '[' || strftime(ts, '%H:%M:%S') || '] page ' || event_id || ' via ' || event_type || ' in ' || user_id || ' s' || CASE WHEN event_id % 4 = 0 THEN ' (cached)' ELSE '' END AS message FROM events")
