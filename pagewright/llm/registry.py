"""The ``opN_<name>`` queries: each applies its operator with production
parameters to its whole table. Each operator module that is listed has a
``QUERIES`` table, and ``ORACLES`` where SQL can express the query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(q.ORACLES)
