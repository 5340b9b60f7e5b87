"""Queries on streams, sources and sinks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sheets as X
from ..operators import summary as M
from ..sources import derived as D
from ..sources import files as S
from ..streaming import jobs as J
from .quality_queries import ORACLES as QUALITY
from .report_queries import ORACLES as REPORTS
from .sql import DOCS

QUERIES, ORACLES = {}, {}


def _add(name, build, sql):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


_plain = QUALITY["vision_decision"]
_start = _plain.index("docs_aug AS (")
_end = _plain.index("FROM documents)", _start) + len("FROM documents)")
_add("stream_intake", lambda s, d: J.run(J.intake(J.source(s, d, "documents"))), _plain[:_start] + "docs_aug AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)" + _plain[_end:])
BATCHES = 4


def _reuse(s, d):
    """Events come in as files of a quarter of their time each, and the job goes on from its checkpoint with each of them."""
    events = D.read(s, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    first, last = events.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    quarter = F.least(F.lit(BATCHES - 1), F.floor((F.unix_micros("ts") - F.lit(first)) * BATCHES / F.lit(max(1, (last or 0) - (first or 0)))))
    intake, folder, out = S.shared_folder(s), S.shared_folder(s), None
    for k in range(BATCHES):
        events.where(quarter == k).write.mode("append").parquet(intake)
        out = J.run(J.reuse(s.readStream.schema(events.schema).parquet(intake), ["user_id", "event_type"]), folder)
    return out.select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


_add("stream_reuse_24h", _reuse, """WITH RECURSIVE e AS (SELECT DISTINCT user_id, event_type, ts FROM events), nx AS (SELECT *, min(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM e),
a AS (SELECT user_id, event_type, min(ts) AS ts FROM e GROUP BY 1, 2 UNION ALL SELECT a.user_id, a.event_type, nx.later FROM a JOIN nx ON nx.user_id = a.user_id AND nx.event_type = a.event_type AND nx.ts = a.ts WHERE nx.later IS NOT NULL) SELECT * FROM a""")
_mark = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
_add("stream_metrics", lambda s, d: J.run(J.window_metrics(J.source(s, d, "events"))), f"WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(event_id % 7) AS BIGINT) AS points FROM events GROUP BY 1, 2) SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= {_mark}")
_add("stream_sliding_metrics", lambda s, d: J.run(J.window_metrics(J.source(s, d, "events"), slide="15 minutes")), f"WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start, event_type, count(*) AS n, CAST(sum(event_id % 7) AS BIGINT) AS points FROM events, range(4) r(k) GROUP BY 1, 2) SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= {_mark}")
_add("stream_sessions", lambda s, d: J.run(J.sessions(J.source(s, d, "events"))), f"WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), h AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM h GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {_mark}")


def _csv(s, d):
    path = S.shared_folder(s)
    D.read(s, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("c_nationkey"), "c_mktsegment").write.option("header", True).csv(path)
    rows = S.read_csv(s, path).withColumn("n", F.col("c_custkey").cast("long"))
    return X.row_listing(rows, "n", ["c_name", "c_nationkey", "c_mktsegment"])


_add("csv_listing", _csv, "SELECT c_custkey AS n, concat_ws(chr(10), '- **Row ' || c_custkey || '**', '  - **c_name**: ' || c_name, CASE WHEN c_custkey % 3 <> 0 THEN '  - **c_nationkey**: ' || c_nationkey END, '  - **c_mktsegment**: ' || c_mktsegment) AS text FROM customer")


def _named(s, d):
    stamp = F.timestamp_seconds(F.lit(1717243200) + F.col("doc_id"))
    return D.docs_aug(s, d).select("doc_id", S.output_name(F.concat(F.lit("plan notes/"), F.col("doc_id").cast("string")), stamp).alias("output_name"), F.col("text").alias("content"))


_keywords = REPORTS["keyword_lines"]
_name = "'plan_notes_' || doc_id || '_' || strftime(TIMESTAMP '2024-06-01 12:00:00' + doc_id * INTERVAL 1 SECOND, '%Y%m%d_%H%M%S') || '.md'"


def _reports(s, d):
    """Summary reports under their own names, written and read back."""
    path = S.shared_folder(s)
    stamp = F.timestamp_seconds(F.lit(1717243200) + F.col("doc_id"))
    S.write_documents(M.keyword_lines(D.docs_aug(s, d)).select(S.output_name(F.concat(F.lit("plan notes/"), F.col("doc_id").cast("string")), stamp, kind="_summary").alias("output_name"), F.col("summary").alias("content")), path)
    return s.read.parquet(path).select("output_name", F.md5("content").alias("digest"))


_add("write_reports", _reports, _keywords.replace("SELECT doc_id, summary, n_found FROM ks", f"SELECT {_name.replace(chr(39) + '_' + chr(39) + ' || strftime', chr(39) + '_summary_' + chr(39) + ' || strftime')} AS output_name, md5(summary) AS digest FROM ks"))


def _json(s, d):
    path = S.shared_folder(s)
    S.write_json(_named(s, d).select("doc_id", F.struct("output_name", F.length("content").alias("size")).alias("result")), path)
    return s.read.schema("doc_id long, result struct<output_name:string,size:long>").json(path).select("doc_id", "result.output_name", "result.size")


_add("write_json", _json, f"WITH {DOCS} SELECT doc_id, {_name} AS output_name, CAST(length(text) AS BIGINT) AS size FROM docs_aug")
