"""Factor evaluation: daily IC and group returns, quality, coverage, and their summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalar import correlation, finite
from tidepanel.operators.keys import date_range, require_columns
from tidepanel.operators.ordered import cell_starts, cut_groups, exact_quantiles, in_order, ranked_in_cells, with_cells
from tidepanel.scale import freeze, null_safe_join, settled

FACTOR = ("factor_name", "label")
FACTOR_DAY = (*FACTOR, "target_trade_date")
QUANTILES = {"p01": 0.01, "p05": 0.05, "p50": 0.50, "p95": 0.95, "p99": 0.99}


def factor_label_rows(
    panel: DataFrame, factors: Sequence[str], labels: Sequence[str], key: str = "sample_id"
) -> DataFrame:
    """Long form: one row per sample, factor and label.

    Every later step groups by factor, label and day, so the work of all factors
    is spread over the cluster at once. The samples are stored once, in the order of the key, and ``_row`` numbers them so (a
    panel that has it is taken as it is); the long form is made from them wherever it is read.
    """
    values = [*[finite(f).alias(f) for f in factors], *[finite(x).alias(f"_y_{x}") for x in labels]]
    if "_row" in panel.columns:
        wide = settled(panel.select(key, "_row", "target_trade_date", *values), "samples")
    else:
        wide = in_order(panel.select(key, "target_trade_date", *values), key, "_row")
    long = wide.unpivot([key, "_row", "target_trade_date", *[f"_y_{x}" for x in labels]], list(factors), "factor_name", "x")
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"_y_{x}").alias("y")) for x in labels]))
    return long.select(key, "_row", "target_trade_date", "factor_name", "x", pairs.alias("_l")).select(
        key, "_row", "target_trade_date", "factor_name", "x", "_l.label", "_l.y"
    )


def daily_ic(
    rows: DataFrame,
    min_pairs: int = 2,
    groups: int = 5,
    key: str = "sample_id"
) -> DataFrame:
    """IC, rank IC, coverage and group spread per factor, label and day.

    A day counts only with ``min_pairs`` pairs and more than one value on both
    sides. The spread is the mean label of the highest group minus the lowest.
    A pair moves twice: to the rows of its factor's cell, and with its rank and group to those of its label's.
    """
    rows, row = _numbered(rows, key)
    pairs = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    usable = _usable(min_pairs)
    days = cut_groups(pairs, FACTOR_DAY, ["x", "y"], row, {"_usable": usable, "ic": F.when(usable, correlation(F.col("x"), F.col("y")))})
    celled = with_cells(pairs, days, FACTOR_DAY, ["x", "y"], row, "x")
    ranked = _grouped(celled, days, groups, row, "rx").select("_cell_y", "y", "rx", "group")
    ranked = ranked_in_cells(ranked, cell_starts(celled, "y"), "y", "ry")
    top, bottom = F.avg(F.when(F.col("group") == groups, F.col("y"))), F.avg(F.when(F.col("group") == 1, F.col("y")))
    stats = ranked.groupBy("_group").agg(correlation(F.col("rx"), F.col("ry")).alias("_rank_ic"), (top - bottom).alias("_spread"))
    stats = days.join(stats, "_group").select(
        *FACTOR_DAY,
        F.col("_total").alias("pair_count"),
        "ic",
        F.when(F.col("_usable"), F.col("_rank_ic")).alias("rank_ic"),
        F.when(F.col("_usable") & (F.col("_total") >= groups), F.col("_spread")).alias("group_spread"),
    )
    counts = rows.groupBy(*FACTOR_DAY).agg(F.count(F.lit(1)).alias("row_count"))
    joined = null_safe_join(counts, stats, FACTOR_DAY).withColumn("pair_count", F.coalesce("pair_count", F.lit(0)))
    return joined.withColumn("coverage", F.col("pair_count") / F.col("row_count"))


def _numbered(rows: DataFrame, key: str) -> tuple[DataFrame, str]:
    """Rows that can be read again, and the column that numbers them in the order of ``key``."""
    return (settled(rows, "pairs") if "_row" in rows.columns else in_order(rows, key, "_row")), "_row"


def _usable(min_pairs: int) -> Column:
    return (F.count(F.lit(1)) >= min_pairs) & (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))


def _grouped(celled: DataFrame, days: DataFrame, groups: int, row: str, rank: str) -> DataFrame:
    """Quantile group 1..q of each pair by factor value, ties in the order of ``row``, and its average ``rank``."""
    kept = [c for c in ("_cell_x", "_cell_y", "x", "y", row) if c in celled.columns]
    ranked = ranked_in_cells(celled.select(*kept), cell_starts(celled, "x"), "x", rank, "_n", row)
    # exact in integers: ceil((n - 1) q / (N - 1)), at least 1
    ranked = ranked.join(days.select("_group", (F.col("_total") - 1).alias("_step")), "_group")
    place = F.floor(((F.col("_n") - 1) * groups + F.col("_step") - 1) / F.greatest("_step", F.lit(1)))
    return ranked.withColumn("group", F.greatest(place, F.lit(1)).cast("int")).drop("_step", "_n")


def group_returns(
    rows: DataFrame, min_pairs: int = 2, groups: int = 5, key: str = "sample_id"
) -> DataFrame:
    """Count and mean label of each quantile group, on days that count."""
    rows, row = _numbered(rows, key)
    pairs = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    days = cut_groups(pairs, FACTOR_DAY, ["x"], row, {"_usable": _usable(max(min_pairs, groups))})
    members = _grouped(with_cells(pairs, days, FACTOR_DAY, ["x"], row, "x"), days, groups, row, "_rank")
    parts = members.groupBy("_group", "group").agg(F.count(F.lit(1)).alias("count"), F.avg("y").alias("mean_return"))
    return days.where("_usable").join(parts, "_group").select(*FACTOR_DAY, "group", "count", "mean_return")


def _rate(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def _ir(x: str) -> Column:
    return F.try_divide(F.avg(x), F.stddev_samp(x))


def factor_summary(daily: DataFrame, keys: Sequence[str] = FACTOR) -> DataFrame:
    """Means, deviations, ratios and positive rates of the daily metrics of each factor and label."""
    return daily.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("target_day_count"),
        F.count("ic").alias("ic_day_count"),
        F.count("rank_ic").alias("rank_ic_day_count"),
        F.avg("pair_count").alias("pair_count_mean"),
        F.avg("coverage").alias("coverage_mean"),
        F.avg("ic").alias("ic_mean"),
        F.stddev_samp("ic").alias("ic_std"),
        _ir("ic").alias("ic_ir"),
        _rate(F.col("ic") > 0).alias("ic_positive_rate"),
        F.avg("rank_ic").alias("rank_ic_mean"),
        F.stddev_samp("rank_ic").alias("rank_ic_std"),
        _ir("rank_ic").alias("rank_ic_ir"),
        _rate(F.col("rank_ic") > 0).alias("rank_ic_positive_rate"),
        F.avg("group_spread").alias("group_spread_mean"),
        _rate(F.col("group_spread") > 0).alias("group_spread_positive_rate"),
    )


def slice_summary(daily: DataFrame, group_rows: DataFrame, since, until, keys: Sequence[str] = FACTOR) -> DataFrame:
    """Summary of stored daily metrics over a range of days, without computing them again.

    Spreads are taken between the highest and the lowest group present.
    """
    inside = date_range(daily, "target_trade_date", since, until)
    base = factor_summary(inside, keys).drop("group_spread_mean", "group_spread_positive_rate")
    spread = slice_spread(group_rows, since, until, keys)
    return null_safe_join(base, spread, keys)


def slice_spread(group_rows: DataFrame, since, until, keys: Sequence[str] = FACTOR) -> DataFrame:
    """Mean and positive rate of the daily spread between the outermost groups present."""
    inside = date_range(group_rows, "target_trade_date", since, until).where(F.col("mean_return").isNotNull())
    outer = inside.groupBy(*keys, "target_trade_date").agg(
        (F.max_by("mean_return", "group") - F.min_by("mean_return", "group")).alias("spread")
    )
    return outer.groupBy(*keys).agg(
        F.count("spread").alias("group_spread_day_count"),
        F.avg("spread").alias("group_spread_mean"),
        _rate(F.col("spread") > 0).alias("group_spread_positive_rate"),
    )


# -- quality -----------------------------------------------------------------------


def factor_quality(
    block: DataFrame,
    samples: DataFrame,
    factors: Sequence[str],
    max_missing_rate: float = 0.98,
    min_non_missing: int = 100,
    min_year_coverage: float = 0.01,
) -> DataFrame:
    """Missing, infinite and non-numeric counts, moments, quantiles, year coverage and flags per factor.

    Only rows of known samples count. Quantiles and distinct counts are exact.
    """
    require_columns(block, ["sample_id", *factors], "block")
    years = samples.select("sample_id", F.year("target_trade_date").cast("bigint").alias("target_year")).dropDuplicates(["sample_id"])
    types = {f.name: f.dataType.typeName() for f in block.schema.fields}
    raw = {f: F.col(f).cast("string") for f in factors}
    # a double is its own text read again
    parsed = {f: F.col(f) if types[f] == "double" else raw[f].try_cast("double") for f in factors}
    cells = [F.struct(parsed[f].alias("v"), (raw[f].isNotNull() & parsed[f].isNull()).alias("odd")).alias(f) for f in factors]
    # a row per sample is stored; the long form is made from it wherever it is read
    rows = freeze(block.select("sample_id", *cells).join(years, "sample_id").select("target_year", *factors), "quality")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("factor_name"), F.col(f"{f}.v").alias("v"), F.col(f"{f}.odd").alias("odd")) for f in factors]))
    long = rows.select("target_year", each.alias("_f")).select("_f.factor_name", "target_year", "_f.v", "_f.odd", finite(F.col("_f.v")).alias("x"))
    nan = F.coalesce(F.isnan("v"), F.lit(False))
    missing = (F.col("v").isNull() & ~F.col("odd")) | nan
    base = long.groupBy("factor_name").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("x").alias("non_missing_count"),
        F.count(F.when(missing, 1)).alias("raw_nan_count"),
        F.count(F.when(F.col("v").isNotNull() & F.col("x").isNull() & ~nan, 1)).alias("inf_count"),
        F.count(F.when(F.col("odd"), 1)).alias("non_numeric_count"),
        _rate(F.col("x") == 0).alias("zero_rate"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    distinct = long.where(F.col("x").isNotNull()).select("factor_name", "x").distinct().groupBy("factor_name").agg(
        F.count(F.lit(1)).alias("unique_count")
    )
    spread = exact_quantiles(long, ["factor_name"], "x", QUANTILES).drop("total")
    names = block.sparkSession.createDataFrame([(f,) for f in factors], "factor_name string")
    parts = [base, distinct, spread, year_coverage(long)]
    out = reduce(lambda a, b: a.join(b, "factor_name", "left"), parts, names)
    out = out.withColumns(
        {
            "unique_count": F.coalesce("unique_count", F.lit(0)),
            "missing_count": F.col("row_count") - F.col("non_missing_count"),
            "missing_rate": F.try_divide(F.col("row_count") - F.col("non_missing_count"), F.col("row_count")),
            "non_missing_rate": F.try_divide(F.col("non_missing_count"), F.col("row_count")),
        }
    ).withColumn("constant_flag", F.col("unique_count") <= 1)
    flags = quality_flags(max_missing_rate, min_non_missing, min_year_coverage)
    return out.withColumn("quality_flags", flags).withColumn("quality_pass", F.col("quality_flags") == "")


def year_coverage(long: DataFrame) -> DataFrame:
    """Share of present values per factor and year: lowest, highest, spread, and the worst year."""
    yearly = long.where(F.col("target_year").isNotNull()).groupBy("factor_name", "target_year").agg(
        _rate(F.col("x").isNotNull()).alias("share")
    )
    return yearly.groupBy("factor_name").agg(
        F.count(F.lit(1)).alias("year_count"),
        F.min("share").alias("year_coverage_min"),
        F.max("share").alias("year_coverage_max"),
        F.stddev_pop("share").alias("year_coverage_std"),
        F.min(F.struct("share", "target_year"))["target_year"].alias("worst_year"),
    )


def quality_flags(max_missing_rate: float, min_non_missing: int, min_year_coverage: float) -> Column:
    """Failed checks in fixed order, joined by semicolons."""
    checks = (
        ("non_numeric_values", F.col("non_numeric_count") > 0),
        ("has_inf", F.col("inf_count") > 0),
        ("missing_rate_high", F.col("missing_rate") > max_missing_rate),
        ("non_missing_too_low", F.col("non_missing_count") < min_non_missing),
        ("constant", F.col("unique_count") <= 1),
        ("year_coverage_low", F.col("year_coverage_min") < min_year_coverage),
    )
    return F.concat_ws(";", *[F.when(condition, F.lit(name)) for name, condition in checks])


def block_match(block: DataFrame, samples: DataFrame) -> DataFrame:
    """How many samples a block covers: matched, missing, extra, and the rate."""
    ours = block.select(F.col("sample_id").cast("string").alias("sample_id")).distinct().withColumn("_b", F.lit(1))
    theirs = samples.select(F.col("sample_id").cast("string").alias("sample_id")).distinct().withColumn("_s", F.lit(1))
    both = ours.join(theirs, "sample_id", "full")
    counted = both.agg(
        F.count("_s").alias("sample_count"),
        F.count(F.when(F.col("_b").isNotNull() & F.col("_s").isNotNull(), 1)).alias("matched_sample_count"),
        F.count(F.when(F.col("_b").isNull(), 1)).alias("missing_sample_count"),
        F.count(F.when(F.col("_s").isNull(), 1)).alias("extra_sample_count"),
    )
    return counted.withColumn("sample_match_rate", F.try_divide(F.col("matched_sample_count"), F.col("sample_count")))


def industry_coverage(df: DataFrame) -> DataFrame:
    """Share of rows without industry, and how many days have any."""
    known = F.coalesce(F.trim(F.col("industry")) != "", F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg((~known).cast("double")).alias("missing_rate"),
        F.countDistinct(F.when(known, F.col("trade_date"))).alias("covered_days"),
    )


def require_industry(df: DataFrame, name: str, max_missing_rate: float = 0.20) -> None:
    """Raise if too many rows lack an industry, or all do."""
    require_columns(df, ["industry"], name)
    row = industry_coverage(df).first()
    rate = 1.0 if row["missing_rate"] is None else row["missing_rate"]
    if rate > max_missing_rate:
        raise ValueError(f"{name}.industry missing rate {rate:.4f} exceeds {max_missing_rate:.4f}")
    if row["covered_days"] == 0:
        raise ValueError(f"{name}.industry has no values")


