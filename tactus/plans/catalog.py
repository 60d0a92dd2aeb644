"""Every query of the library outside the corpus operators, with its SQL where there is one."""

from tactus.plans import evaluation_queries, mixing_queries, reference_queries, rule_queries, score_queries, series_queries, signal_queries, table_queries

_PARTS = (series_queries, signal_queries, table_queries, evaluation_queries, rule_queries, reference_queries, mixing_queries, score_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
