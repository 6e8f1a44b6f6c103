"""All named queries of the library and their SQL."""

from __future__ import annotations

from . import data_queries, detect_queries, landing_queries, panel_queries, rollup_queries, search_queries, stream_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (search_queries, data_queries, landing_queries, rollup_queries, detect_queries, panel_queries, stream_queries):
    QUERIES |= _m.R.queries
    ORACLES |= _m.R.oracles
FLAGSHIP = "slice1_top_failed_sources"
