"""Operations of a training-data pipeline. Nothing else in the package imports this.

Python workers import the module of the operator they run, so this imports none of them by itself."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import entries

    return entries.queries()


def oracle_sql() -> dict[str, str]:
    from . import entries

    return entries.oracle_sql()


__all__ = ["oracle_sql", "queries"]
