"""Registered queries over the document operators, with the SQL that each is held against."""

from __future__ import annotations

from . import chunk_queries, function_queries, pdf_queries, policy_queries, reader_queries, table_queries  # noqa: F401  each registers its own
from .registry import QUERIES, SQL

FLAGSHIP = "chunk_documents"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
