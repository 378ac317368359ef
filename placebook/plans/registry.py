"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import catalogs, files, ledgers, more, payments, resolving, serving

QUERIES = payments.QUERIES | resolving.QUERIES | serving.QUERIES | more.QUERIES | ledgers.QUERIES | catalogs.QUERIES | files.QUERIES
SQL = payments.SQL | resolving.SQL | serving.SQL | more.SQL | ledgers.SQL | catalogs.SQL | files.SQL
flagship = payments.flagship
