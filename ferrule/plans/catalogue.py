"""All queries of the program-fact operators."""

from __future__ import annotations

from . import fact_queries, flow_queries, queries, text_queries

QUERIES = {**queries.QUERIES, **flow_queries.QUERIES, **text_queries.QUERIES, **fact_queries.QUERIES}
ORACLES = {**queries.ORACLES, **flow_queries.ORACLES, **text_queries.ORACLES, **fact_queries.ORACLES}
