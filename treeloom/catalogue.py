"""All registered queries of the fleet analytics, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import dag, history, keys, live, mainline, objects, status, trees

AREAS = (dag, trees, keys, history, live, mainline, objects, status)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for area in AREAS for name, query in area.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in area.ORACLES.items()}
