"""Every query of this subpackage and its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES (name to callable) and ORACLE (name to SQL).
MODULES = ["chartloom.llm.variants", "chartloom.llm.privacy", "chartloom.llm.linkage", "chartloom.llm.survivors", "chartloom.llm.tokens", "chartloom.llm.sentences", "chartloom.llm.leaks"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(m).ORACLE.items()}
