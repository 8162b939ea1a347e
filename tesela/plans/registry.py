"""Registered queries of the core and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tesela.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under ``name``, with its SQL if there is one."""

    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = with_checkpoints(function)
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


def with_checkpoints(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, sure of a checkpoint folder: the session's, or one of its own where none is set."""

    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        return function(spark, folder)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to ``places`` decimals, so that sums in another order compare equal; minus zero is zero."""
    from pyspark.sql import functions as F

    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
