"""All queries of the library outside the llm folder, with their SQL."""

from __future__ import annotations

from termweave.plans import article_catalogue, graph_catalogue, links_catalogue, text_catalogue
from termweave.plans.text_catalogue import similar_documents

__all__ = ["oracle_sql", "queries", "similar_documents"]
PARTS = (graph_catalogue, text_catalogue, article_catalogue, links_catalogue)


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
