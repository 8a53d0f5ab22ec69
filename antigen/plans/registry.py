"""All queries by name, each with its SQL twin where there is one."""

from __future__ import annotations

from antigen.plans import data_queries, grid_queries, run_queries

QUERIES: dict = {**data_queries.QUERIES, **run_queries.QUERIES, **grid_queries.QUERIES}
ORACLES: dict[str, str] = {**data_queries.ORACLES, **run_queries.ORACLES, **grid_queries.ORACLES}
