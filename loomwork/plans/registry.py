"""All queries of the library and their SQL oracles, collected from the job modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.plans import base, cell_tables, extraction, metrics, pages, quality, review, rollover, rollover_job, streams, text  # noqa: F401  (importing a module registers its queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["e23_rollover"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
