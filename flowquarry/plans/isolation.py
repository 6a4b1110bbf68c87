"""Metrics that may fail or be switched off without stopping the run they belong to."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


def isolated(spark: SparkSession, name: str, build: Callable[[], DataFrame], schema: str, flags: dict[str, bool] | None = None) -> DataFrame:
    """The metric ``build`` plans, or one row of nulls of ``schema`` if its flag is off or its plan can't be built.

    Only the building is guarded, as an engine that plans lazily can guard no more: a plan that is sound and fails while it runs fails the run. A missing flag is on.
    """
    nothing = spark.createDataFrame([tuple(None for _ in spark.createDataFrame([], schema).columns)], schema)
    if not (flags or {}).get(name, True):
        log.info("metric %s is off", name)
        return nothing
    try:
        df = build()
        missing = set(nothing.columns) - set(df.columns)  # reading the columns analyses the plan
        if missing:
            raise ValueError(f"columns {sorted(missing)} are missing")
        return df.select(*nothing.columns)
    except (PySparkException, ValueError, KeyError, ArithmeticError):
        log.exception("metric %s failed", name)
        return nothing
