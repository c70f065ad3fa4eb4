"""Registry of queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query, with its oracle when SQL can express it."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def plain(df: DataFrame, digits: int = 2) -> DataFrame:
    """Numbers as rounded doubles, so both engines print the same value."""
    out = []
    for name, dtype in df.dtypes:
        c = F.col(f"`{name}`")
        if dtype.startswith("decimal") or dtype in ("double", "float"):
            c = F.round(c.cast("double"), digits)
        out.append(c.alias(name))
    return df.select(*out)
