"""The registry of queries: each module of strandline.plans adds its own."""

from __future__ import annotations

from strandline.plans import ancestry, events, keyed, lineage, more, papers, review, state, store, texts  # noqa: F401
from strandline.plans.registry import QUERIES, SQL

FLAGSHIP = "review_manifest"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
