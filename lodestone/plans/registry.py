"""Named queries and their SQL twins, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus, evaluation, retrieval, structured, tables

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (structured, retrieval, evaluation, corpus, tables)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["hybrid_rrf"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
