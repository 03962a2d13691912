"""Named queries over the engine, and their SQL."""

from __future__ import annotations

from tidewell.plans import endpoint_queries, extract_queries, run_queries


def queries() -> dict:
    return {**endpoint_queries.QUERIES, **extract_queries.QUERIES, **run_queries.QUERIES}


def oracles() -> dict:
    return {**endpoint_queries.ORACLES, **extract_queries.ORACLES, **run_queries.ORACLES}
