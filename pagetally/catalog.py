"""All registered queries of the counting engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from .operators import auditing, counting, inference, parsing, patching, storage, sweeps
from .plans.relations import Session, duck
from .streaming import events, locks, scans

TEXTS = counting.FILES | counting.CELLS | counting.PAGES | auditing.OPERATORS | patching.OPERATORS
FRAMES: dict[str, Callable[[Session], DataFrame]] = inference.OPERATORS | parsing.OPERATORS | storage.OPERATORS | sweeps.OPERATORS | events.OPERATORS | locks.OPERATORS | scans.OPERATORS
#: SQL of operators that are not one text for both dialects.
SQL = auditing.ORACLE | patching.ORACLE | inference.SQL | parsing.SQL | storage.SQL | sweeps.SQL | events.SQL | locks.SQL | scans.SQL


def _text(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(spark, sf_dir).query(TEXTS[name])


def _frame(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return FRAMES[name](Session(spark, sf_dir, inference.FRAMES))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: partial(_text, n) for n in TEXTS} | {n: partial(_frame, n) for n in FRAMES}


def oracle_sql() -> dict[str, str]:
    return {n: duck(t) for n, t in TEXTS.items()} | {n: duck(t) for n, t in SQL.items()}
