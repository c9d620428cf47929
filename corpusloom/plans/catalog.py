"""All queries of the core, with the SQL that expresses the same on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import corpus, deliveries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return corpus.queries() | deliveries.queries()


def oracle_sql() -> dict[str, str]:
    return corpus.oracle_sql() | deliveries.oracle_sql()
