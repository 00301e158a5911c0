"""Name -> query and name -> oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.plans import registry

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return registry.load()[0]


def oracle_sql() -> dict[str, str]:
    return registry.load()[1]
