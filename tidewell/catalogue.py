"""Queries of the library and the SQL that gives the same rows."""

from tidewell.plans import base, document_queries, more_queries, record_queries, text_queries  # noqa: F401

QUERIES = base.QUERIES
ORACLE = base.ORACLE
