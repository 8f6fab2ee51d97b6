"""The queries, by name, and their SQL."""

from __future__ import annotations

from . import general, store, store_sql

QUERIES = {**store.QUERIES, **general.QUERIES}
ORACLE = {**store_sql.ORACLE, **general.ORACLE}
