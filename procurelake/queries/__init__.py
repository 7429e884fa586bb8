"""The registered queries over the driver's tables, and the SQL that checks them."""

from procurelake.queries import core, oracle, paths, tenders

QUERIES = core.QUERIES | paths.QUERIES | tenders.QUERIES
ORACLE_SQL = oracle.ORACLE_SQL | paths.ORACLE_SQL | tenders.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
