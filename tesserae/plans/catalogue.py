"""Registry of the engine's own queries."""

from __future__ import annotations

from tesserae.plans import cell_queries, plan_queries, raster_queries

FLAGSHIP = "alloc_structural"
REGISTRIES = (raster_queries.R, cell_queries.R, plan_queries.R)


def queries() -> dict:
    return {name: call for r in REGISTRIES for name, call in r.calls.items()}


def oracle_sql() -> dict:
    return {name: sql for r in REGISTRIES for name, sql in r.sql.items()}
