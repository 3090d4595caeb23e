"""All registered queries but those of optional subpackages."""

from driftline.plans import ingest_queries, metric_queries, set_queries, text_queries, vector_queries

QUERIES, SQL = {}, {}
for module in (vector_queries, text_queries, metric_queries, set_queries, ingest_queries):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
