"""Names of all registered queries."""

from ledgerlark.plans import feature_queries, label_queries, score_queries, source_queries, warehouse_queries

BOOKS = [feature_queries.book, label_queries.book, warehouse_queries.book, score_queries.book, source_queries.book]
QUERIES = {name: q for b in BOOKS for name, q in b.queries.items()}
ORACLES = {name: sql for b in BOOKS for name, sql in b.oracles.items()}
