"""Every query of the core and its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES (name to callable) and ORACLE (name to SQL).
MODULES = [f"chartloom.operators.{m}" for m in "references units facts chart graph temporal texts extraction identity retrieval calibration questions claims registry evaluation views prose".split()] + ["chartloom.sources.uploads"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(m).ORACLE.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["trend_trade"](spark, sf_dir)
