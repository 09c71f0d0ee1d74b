"""Names of all queries, with the SQL each is held against."""

from __future__ import annotations

from netloom.plans.queries import QUERIES, SQL, Query

FLAGSHIP = "wn01_ranked_variants"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
