"""Queries and their SQL oracles, by name."""

from . import mechanisms, streams, tables, trajectory

QUERIES: dict = {**tables.QUERIES, **trajectory.QUERIES, **mechanisms.QUERIES, **streams.QUERIES}
ORACLE_SQL: dict = {**tables.ORACLE_SQL, **trajectory.ORACLE_SQL, **mechanisms.ORACLE_SQL, **streams.ORACLE_SQL}
