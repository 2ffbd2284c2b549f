"""Query registry: name → (Spark builder, oracle SQL or None).

A Spark builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose timestamps are
naive UTC (``to_output``).  The oracle SQL runs on DuckDB over the same base tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import to_output

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}
IDS: dict[str, str] = {}


def query(name: str, oracle: str | None, survey_id: str = ""):
    def deco(fn: Callable[[SparkSession, str], DataFrame]) -> Builder:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return to_output(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        IDS[name] = survey_id
        return run

    return deco
