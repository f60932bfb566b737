"""Key checks, duplicates, key lists and date selections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalar import finite


def require_columns(df: DataFrame, columns: Sequence[str], name: str = "table") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing {name} columns: {missing}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their row counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def require_unique(df: DataFrame, keys: Sequence[str], name: str = "table") -> None:
    """Raise with a few examples if a key value occurs twice."""
    examples = duplicate_keys(df, keys).limit(5).collect()
    if examples:
        raise ValueError(f"{name} keys must be unique, duplicates: {[row.asDict() for row in examples]}")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the last by ``order``.

    The row-number-equals-one filter is applied on both sides of the shuffle, so
    a key with very many copies is thinned out where its rows are read.
    """
    by = [(F.col(o) if isinstance(o, str) else o).desc_nulls_last() for o in order]
    return _one_per_key(df, keys, by)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first by ``order``."""
    by = [(F.col(o) if isinstance(o, str) else o).asc_nulls_first() for o in order]
    return _one_per_key(df, keys, by)


def _one_per_key(df: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def removed_rows(before: DataFrame, after: DataFrame) -> int:
    return before.count() - after.count()


def exclude_keys(df: DataFrame, listed: DataFrame, date: str = "trade_date") -> DataFrame:
    """Drop rows whose (stock_code, date) is listed."""
    keys = listed.select(
        F.col("stock_code").alias("_code"), F.col("trade_date").cast("date").alias("_day")
    ).dropna().distinct()
    return df.join(
        keys, (F.col("stock_code") == F.col("_code")) & (F.col(date).cast("date") == F.col("_day")), "left_anti"
    )


def exclude_samples(
    samples: DataFrame,
    listed: DataFrame,
    dates: Sequence[str] = ("feature_asof_date", "target_trade_date", "label_end_date"),
) -> DataFrame:
    """Drop samples that touch a listed day with any of their dates."""
    present = [d for d in dates if d in samples.columns]
    return reduce(lambda rows, d: exclude_keys(rows, listed, d), present, samples)


def exclude_exchange(df: DataFrame, suffix: str = ".BJ", market_word: str = "北交") -> DataFrame:
    """Drop one exchange, known by the end of the code or a word in the market name."""
    out = F.coalesce(F.col("stock_code").endswith(suffix), F.lit(False))
    if "market" in df.columns:
        out = out | F.coalesce(F.col("market").contains(market_word), F.lit(False))
    return df.where(~out)


# Code prefixes and name marks that leave the tradable universe.
EXCLUDED_PREFIXES = ("43", "83", "87", "88", "89")
SPECIAL_TREATMENT = "ST"
DELISTING = "退"


def tradable_universe(df: DataFrame, exclude_special: bool = False, exclude_exchange_bj: bool = False) -> DataFrame:
    """Drop special-treatment and delisting names, and one exchange by suffix or prefix."""
    work = df
    if exclude_special and "stock_name" in df.columns:
        name = F.coalesce(F.col("stock_name").cast("string"), F.lit(""))
        work = work.where(~F.upper(name).contains(SPECIAL_TREATMENT) & ~name.contains(DELISTING))
    if exclude_exchange_bj:
        code = F.col("stock_code").cast("string")
        work = work.where(~code.endswith(".BJ") & ~F.substring(code, 1, 2).isin(*EXCLUDED_PREFIXES))
    return work


def date_range(df: DataFrame, date: str, since=None, until=None) -> DataFrame:
    """Inclusive date filter; apply it after windows that need the history."""
    if since is not None:
        df = df.where(F.col(date) >= F.lit(str(since)).cast("date"))
    if until is not None:
        df = df.where(F.col(date) <= F.lit(str(until)).cast("date"))
    return df


def first_dates(df: DataFrame, n: int, date: str = "target_trade_date") -> DataFrame:
    """Rows of the first n distinct dates."""
    if n <= 0:
        raise ValueError("n must be positive")
    kept = df.select(date).where(F.col(date).isNotNull()).distinct().orderBy(date).limit(n)
    return df.join(kept, date, "left_semi")


def on_dates(df: DataFrame, dates: DataFrame, date: str = "target_trade_date") -> DataFrame:
    """Rows whose date is in the list."""
    return df.join(dates.select(F.col(dates.columns[0]).alias(date)).distinct(), date, "left_semi")


def on_latest_date(df: DataFrame, date: str = "target_trade_date") -> DataFrame:
    return df.where(F.col(date) == df.agg(F.max(date)).scalar())


def common_entities(tables: Sequence[DataFrame], n: int, entity: str = "stock_code") -> list[DataFrame]:
    """Every table cut to the first n entities that all tables have."""
    ids = [t.select(entity).where(F.col(entity).isNotNull()) for t in tables]
    chosen = reduce(DataFrame.intersect, ids).distinct().orderBy(entity).limit(n)
    return [t.join(chosen, entity, "left_semi") for t in tables]


def split_filter(
    samples: DataFrame, split: str, ranges: dict[str, tuple[str, str | None]], date: str = "target_trade_date"
) -> DataFrame:
    """Samples of the train, validation or holdout range (an open end allowed), or all."""
    if split == "all":
        return samples
    split = "validation" if split in {"valid", "val"} else split
    if split not in ranges:
        raise ValueError(f"unknown split: {split}")
    return date_range(samples, date, *ranges[split])


def with_label(samples: DataFrame, label: str) -> DataFrame:
    """Rows whose label is a finite number."""
    require_columns(samples, [label], "samples")
    return samples.where(finite(label).isNotNull())


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 20260520) -> DataFrame:
    """n rows in the order of a seeded hash of the key: the same rows in every run, and in any engine."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)
