"""Named queries over the binding views, each with its DuckDB twin where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.binding import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a function of the views under its own name."""

    def wrap(build: Callable[[Views], DataFrame]):
        key = name or build.__name__
        QUERIES[key] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if oracle:
            ORACLES[key] = with_views(oracle)
        return build

    return wrap


from . import q_aggregates, q_carbon_planting, q_filters, q_functions, q_joins, q_pixels, q_rings, q_scoring, q_sources, q_stats, q_streams, q_windows  # noqa: E402, F401
