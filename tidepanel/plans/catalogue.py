"""Checks and choices on the catalog of factor blocks: one row per block or feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.scalar import number

BLOCK_SCHEMA = "name string, granularity string, row_count bigint, factor_count int, factors array<string>"

# Feature groups by block or name, tried in this order.
MINED_PREFIX = "gpt_mined_"
MINED_GROUPS = {
    "gpt_mined_industry_relative": "industry_relative",
    "gpt_mined_interaction": "interaction",
    "gpt_mined_liquidity": "liquidity",
    "gpt_mined_moneyflow": "moneyflow",
    "gpt_mined_news_state": "news",
    "gpt_mined_regime_momentum": "regime_momentum",
    "gpt_mined_reversal": "reversal",
    "gpt_mined_risk_control": "risk_control",
    "gpt_mined_valuation": "valuation",
}
PRICE_PREFIXES = ("alpha158_low", "alpha158_high", "alpha158_vwap")


def block_features(blocks: DataFrame) -> DataFrame:
    """One row per block and feature."""
    return blocks.select(F.col("name").alias("block"), F.explode("factors").alias("factor_name"))


def duplicate_features(blocks: DataFrame) -> DataFrame:
    """Features found in more than one block, with the blocks."""
    found = block_features(blocks).groupBy("factor_name").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    return found.where(F.size("blocks") > 1).select("factor_name", F.array_join("blocks", ";").alias("blocks"))


def block_problems(blocks: DataFrame, actual: DataFrame) -> DataFrame:
    """Blocks whose catalog row disagrees with the written table, with the ``problem``.

    ``actual`` has name, rows and columns of each written block.
    """
    joined = blocks.join(actual, "name", "full")
    names = F.coalesce("factors", F.array().cast("array<string>"))
    missing = F.array_except(names, F.coalesce("columns", F.array().cast("array<string>")))
    problem = F.concat_ws(
        ";",
        F.when(F.col("factors").isNull(), "not in catalog"),
        F.when(F.col("columns").isNull(), "not written"),
        F.when(F.col("row_count") != F.col("rows"), "row count"),
        F.when(F.col("factor_count") != F.size(names), "factor count"),
        F.when(F.size(F.array_distinct(names)) < F.size(names), "duplicate factor"),
        F.when(F.col("columns").isNotNull() & (F.size(missing) > 0), F.concat(F.lit("missing:"), F.array_join(missing, ","))),
    )
    return joined.withColumn("problem", problem).where(F.col("problem") != "").select("name", "problem")


def describe_block(df: DataFrame, name: str) -> DataFrame:
    """The ``actual`` row of a written table: its rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("name"), "rows", F.array(*[F.lit(c) for c in df.columns]).alias("columns")
    )


def present_values(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature of a written table: its rows and how many of them have a value, counted in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{f}`")).alias(f) for f in features])
    return counts.unpivot(["_rows"], list(features), "factor_name", "present").withColumnRenamed("_rows", "rows")


def feature_group(feature: Column, block: Column) -> Column:
    """Semantic group of a feature from its block and its name."""
    key = F.lower(F.concat_ws(":", F.coalesce(block, F.lit("")), feature))
    lowered = F.lower(F.coalesce(block, F.lit("")))
    family = F.regexp_replace(lowered, "_sample$", "")
    mined = F.coalesce(
        *[F.when(family == b, g) for b, g in MINED_GROUPS.items()],
        F.coalesce(F.nullif(F.regexp_replace(family, f"^{MINED_PREFIX}", ""), F.lit("")), F.lit("other")),
    )
    starts = lambda *prefixes: feature.rlike("^(" + "|".join(prefixes) + ")")
    return (
        F.when(lowered.startswith(MINED_PREFIX), mined)
        .when(key.contains("news"), "news")
        .when(key.contains("moneyflow") | starts("mf_"), "moneyflow")
        .when(key.contains("metric") | starts("metric_"), "metric")
        .when(key.contains("alpha158_kbar") | starts("alpha158_k"), "alpha158_kbar")
        .when(key.contains("alpha158_price") | starts(*PRICE_PREFIXES), "alpha158_price")
        .when(key.contains("alpha158_return") | starts("alpha158_roc"), "alpha158_return")
        .when(key.contains("alpha158_rolling"), "alpha158_rolling")
        .when(starts("alpha158_"), "alpha158")
        .otherwise("other")
    )


def feature_modality(feature: Column, block: Column, text_prefixes: Sequence[str]) -> Column:
    """``text`` for news features and the given prefixes, ``fundamental`` for the rest."""
    text = F.lower(F.coalesce(block, F.lit(""))).contains("news")
    for prefix in text_prefixes:
        text = text | feature.startswith(prefix)
    return F.when(text, "text").otherwise("fundamental")


def chosen_features(reviewed: DataFrame | None, automatic: DataFrame | None) -> DataFrame:
    """The reviewed feature list if there is one, else the automatic one; repeats dropped, first place kept.

    Lists have ``place`` and ``factor_name``.
    """
    source, mode = (reviewed, "reviewed") if reviewed is not None else (automatic, "auto")
    if source is None:
        raise FileNotFoundError("no feature list")
    return source.groupBy("factor_name").agg(F.min("place").alias("place")).withColumn("mode", F.lit(mode))


def existing_factors(candidates: DataFrame, selected: DataFrame, most: int | None = None) -> DataFrame:
    """Factors in order of selection, score and name; a row limit keeps all selected ones first."""
    mine = selected.select("factor_name", F.lit(True).alias("_mine")).distinct()
    had = F.col("selected") if "selected" in candidates.columns else F.lit(None).cast("boolean")
    work = candidates.withColumn("_had", had).drop("selected").join(mine, "factor_name", "left")
    now = F.coalesce("_mine", F.lit(False))
    work = work.withColumns({"selected": now, "auto_selected": F.coalesce("_had", now)}).drop("_mine", "_had")
    score = F.coalesce(number("selection_score"), F.lit(-1.0)) if "selection_score" in work.columns else F.lit(-1.0)
    ordered = work.orderBy(F.col("selected").desc(), score.desc(), "factor_name")
    return ordered.limit(most) if most else ordered
