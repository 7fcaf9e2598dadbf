"""Queries by the survey's operator ids, each with DuckDB SQL where SQL can express it."""

from packmill.queries import aggregates, joins, numeric, retrieval, sources, streams, text, writes
from packmill.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "aggregates", "joins", "numeric", "retrieval", "sources", "streams", "text", "writes"]
