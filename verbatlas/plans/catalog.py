"""All queries over the reference tables, with the SQL that gives the same rows."""

from verbatlas.plans import consult_queries, etl_queries, relational_queries, search_queries

MODULES = [search_queries, relational_queries, etl_queries, consult_queries]
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for module in MODULES:
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.SQL
