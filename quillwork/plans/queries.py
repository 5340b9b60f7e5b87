"""All queries of the library and their SQL."""

from . import page_queries, quality_queries, report_queries, sheet_queries, store_queries, stream_queries, text_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (quality_queries, page_queries, text_queries, report_queries, sheet_queries, stream_queries, store_queries):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
