"""Every query by name, with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewire.plans import edition_queries, serving_queries, state_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**edition_queries.QUERIES, **serving_queries.QUERIES, **state_queries.QUERIES}
ORACLES: dict[str, str] = {**edition_queries.ORACLES, **serving_queries.ORACLES, **state_queries.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composed edition."""
    return edition_queries.q14(spark, sf_dir)
