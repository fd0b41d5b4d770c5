"""Every registered query of the library proper, and the SQL that each is checked against."""

from __future__ import annotations

from gatelight.plans import conformance_queries, dependence_queries, order_records, record_queries, report_queries, sketch_queries, statistics_queries

FLAGSHIP = "q_state_fold"
QUERIES = conformance_queries.QUERIES | dependence_queries.QUERIES | order_records.QUERIES | record_queries.QUERIES | report_queries.QUERIES | sketch_queries.QUERIES | statistics_queries.QUERIES
ORACLE_SQL = conformance_queries.ORACLE_SQL | dependence_queries.ORACLE_SQL | order_records.ORACLE_SQL | record_queries.ORACLE_SQL | report_queries.ORACLE_SQL | sketch_queries.ORACLE_SQL | statistics_queries.ORACLE_SQL

#: Grids and simulations over no given table, with their SQL: parts of the library that aren't registered as queries.
STUDIES = report_queries.STUDIES | statistics_queries.STUDIES
STUDY_SQL = report_queries.STUDY_SQL | statistics_queries.STUDY_SQL
