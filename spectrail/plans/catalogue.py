"""Registry of the queries over the driver's tables and of their SQL twins."""

from __future__ import annotations

from spectrail.plans import files, inference, modelling, observations, posteriors, views

PARTS = (observations, files, modelling, posteriors, inference, views)


def queries() -> dict:
    return {name: query for part in PARTS for name, (query, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, (_, sql) in part.QUERIES.items() if sql}
