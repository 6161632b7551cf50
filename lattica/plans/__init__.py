"""Queries over the driver's tables, one or more for each operator, with the SQL that gives the same rows."""

from lattica.plans import frames, nested, relational, scalars, storage, windows

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (scalars, relational, frames, nested, windows, storage):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
