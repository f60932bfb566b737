"""Registry of queries and the helpers that keep both sides comparable."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can say the same."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tidy(df: DataFrame, digits: int = 6, keep: Sequence[str] = ()) -> DataFrame:
    """Round every double column, so that the order of a float sum does not show."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double" and f.name not in keep:
            out.append((F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def rounded(columns: Sequence[str], digits: int = 6, source: str = "") -> str:
    """The SQL of :func:`tidy` for these columns."""
    prefix = f"{source}." if source else ""
    return ", ".join(f"round({prefix}{c}, {digits}) + 0 AS {c}" for c in columns)
