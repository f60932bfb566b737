"""Writers: tables, previews and checked factor blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators.keys import require_columns, require_unique
from tidepanel.scale import stage_path


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    """Write a table as parquet, csv (with header) or json."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)
    return path


def replace_folder(spark: SparkSession, staged: str, target: str) -> None:
    """Put a finished folder in the place of another; the old one goes only once the new one is complete."""
    jvm = spark._jvm
    source, goal = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(target)
    fs = goal.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(goal.getParent())
    aside = jvm.org.apache.hadoop.fs.Path(target + ".old")
    had_old = fs.exists(goal)
    if had_old:
        fs.delete(aside, True)
        if not fs.rename(goal, aside):
            raise OSError(f"cannot move {target} aside")
    if not fs.rename(source, goal):
        if had_old:
            fs.rename(aside, goal)
        raise OSError(f"cannot move {staged} to {target}")
    fs.delete(aside, True)


def write_block(
    df: DataFrame, path: str, factors: Sequence[str], keys: Sequence[str] = ("stock_code", "trade_date")
) -> dict[str, object]:
    """Write key and factor columns only, checked, replacing an old block as a whole.

    Returns the block's catalog row.
    """
    factors = list(factors)
    require_columns(df, [*keys, *factors], "block")
    if len(set(factors)) != len(factors):
        raise ValueError("factor names must be unique")
    staged = path.rstrip("/") + ".new"
    spark = df.sparkSession
    df.select(*keys, *factors).write.mode("overwrite").parquet(staged)
    written = spark.read.parquet(staged)
    require_unique(written, keys, "factor block")
    rows = written.count()
    replace_folder(spark, staged, path)
    return {
        "name": path.rstrip("/").rsplit("/", 1)[-1],
        "factor_path": path,
        "granularity": "sample" if tuple(keys) == ("sample_id",) else "daily",
        "row_count": rows,
        "factor_count": len(factors),
        "factors": factors,
    }


def block_is_complete(
    spark: SparkSession, path: str, row_count: int, factors: Sequence[str], keys: Sequence[str]
) -> bool:
    """True if a written block has these rows and columns, so a build may skip it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return False
    df = spark.read.parquet(path)
    return set(df.columns) == {*keys, *factors} and df.count() == row_count


def preview(df: DataFrame, order: Sequence[str], rows: int = 2000) -> DataFrame:
    return df.orderBy(*[F.col(c) for c in order]).limit(rows)


__all__ = ["block_is_complete", "preview", "replace_folder", "stage_path", "write_block", "write_table"]
