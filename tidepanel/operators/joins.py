"""Joins that attach one table to another without looking ahead."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.scale import freeze, null_safe_join, settled, spread
from tidepanel.functions.scalar import col, number, safe_div
from tidepanel.operators.keys import require_columns, require_unique

STATIC_COLUMNS = ("stock_name", "industry", "market", "area", "list_date")


def attach_static(df: DataFrame, basic: DataFrame, fields: Sequence[str] = ("industry",)) -> DataFrame:
    """Add per-entity fields; a value already present wins over the static one.

    ``basic`` must have one row per stock_code.
    """
    fields = [f for f in fields if f in basic.columns]
    if not fields:
        return df
    side = basic.select("stock_code", *[F.col(f).alias(f"_{f}") for f in fields])
    joined = df.join(side, "stock_code", "left")
    for f in fields:
        own = F.col(f) if f in df.columns else F.lit(None)
        joined = joined.withColumn(f, F.coalesce(own, F.col(f"_{f}"))).drop(f"_{f}")
    return joined


def fill_blank_industry(df: DataFrame, basic: DataFrame) -> DataFrame:
    """Static industry where the table has none or only blanks."""
    side = basic.select("stock_code", F.col("industry").alias("_industry"))
    joined = df.join(side, "stock_code", "left")
    if "industry" not in df.columns:
        return joined.withColumnRenamed("_industry", "industry")
    own = F.when(F.trim("industry") != "", F.col("industry"))
    return joined.withColumn("industry", F.coalesce(own, F.col("_industry"))).drop("_industry")


def daily_panel(price: DataFrame, *others: DataFrame) -> DataFrame:
    """Price rows with the columns of other daily tables; their static columns are left out."""
    keys = ["trade_date", "stock_code"]
    panel = price
    for other in others:
        keep = [c for c in other.columns if c not in STATIC_COLUMNS and c != "__source_file"]
        clash = [c for c in keep if c in panel.columns and c not in keys]
        side = other.select(*[F.col(c).alias(f"{c}_y") if c in clash else F.col(c) for c in keep])
        for c in clash:
            panel = panel.withColumnRenamed(c, f"{c}_x")
        panel = panel.join(side, keys, "left")
    return panel


def align_to_samples(samples: DataFrame, daily: DataFrame, factors: Sequence[str] | None = None) -> DataFrame:
    """Daily factors at each sample's ``feature_asof_date``, never at its target date.

    Raises if a daily key is not unique or a factor column already exists.
    """
    require_columns(samples, ("sample_id", "stock_code", "feature_asof_date"), "samples")
    require_columns(daily, ("stock_code", "trade_date"), "daily factors")
    factors = list(factors) if factors is not None else [
        c for c in daily.columns if c not in ("stock_code", "trade_date")
    ]
    clash = sorted(set(samples.columns) & set(factors))
    if clash:
        raise ValueError(f"factor columns already exist in samples: {clash}")
    side = daily.select(
        "stock_code", F.col("trade_date").cast("date").alias("feature_asof_date"), *factors
    ).dropna(subset=["stock_code", "feature_asof_date"])
    require_unique(side, ("stock_code", "feature_asof_date"), "daily factor")
    return samples.join(side, ["stock_code", "feature_asof_date"], "left")


def forward_trade_day(
    df: DataFrame, calendar: DataFrame, time: str, out: str = "trade_date", cutoff_hour: int = 15
) -> DataFrame:
    """First trading day on or after the day of ``time`` (the next day from the cutoff hour on).

    Only distinct days are matched, so the single ordered pass runs over a
    calendar's worth of rows; the table itself is joined to its result.
    """
    base = F.col(time).cast("date")
    base = F.when(F.hour(time) >= cutoff_hour, F.date_add(base, 1)).otherwise(base)
    work = df.withColumn("_day", base)
    days = calendar.select(F.col(calendar.columns[0]).cast("date").alias("_day")).dropna().distinct()
    points = (
        days.withColumn("_open", F.lit(True))
        .unionByName(work.select("_day").dropna().distinct().withColumn("_open", F.lit(False)))
        .groupBy("_day")
        .agg(F.max("_open").alias("_open"))
    )
    ahead = Window.orderBy("_day").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    mapped = points.select(
        "_day", F.first(F.when(F.col("_open"), F.col("_day")), ignorenulls=True).over(ahead).alias(out)
    )
    return work.drop(out).join(mapped, "_day", "left").drop("_day")


def on_calendar(calendar: DataFrame, daily: DataFrame, counts: Sequence[str], texts: Sequence[str] = ()) -> DataFrame:
    """Every trading day with its aggregates; counts become 0 and texts empty where there are none."""
    days = calendar.select(F.col(calendar.columns[0]).cast("date").alias("trade_date")).dropna().distinct()
    dense = days.join(daily, "trade_date", "left")
    return dense.withColumns(
        {**{c: F.coalesce(F.col(c), F.lit(0)) for c in counts}, **{t: F.coalesce(F.col(t), F.lit("")) for t in texts}}
    )


def attach_news_counts(samples: DataFrame, stock_daily: DataFrame, market_daily: DataFrame) -> DataFrame:
    """Daily stock news with its text's digest, and market counts, at each sample's trade_date; counts filled with 0."""
    work = samples.join(stock_daily, ["sample_id", "stock_code", "trade_date"], "left")
    market = market_daily.drop("market_news_text_sha256", "market_text_parts")
    work = work.join(market, "trade_date", "left")
    return work.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("news_count", "text_parts", "market_news_count") if c in work.columns}
    )


def attach_price(flow: DataFrame, price: DataFrame) -> DataFrame:
    """Amount and close of the same entity and day; price industry where the flow has none.

    Price must be unique on (stock_code, trade_date).
    """
    keys = ["stock_code", "trade_date"]
    columns = ["amount", "close"]
    side = price.select(*keys, *columns, *(["industry"] if "industry" in price.columns else []))
    if "industry" not in price.columns:
        return flow.join(side, keys, "left")
    work = flow.join(side.withColumnRenamed("industry", "_industry"), keys, "left")
    own = F.col("industry") if "industry" in flow.columns else F.lit(None)
    return work.withColumn("industry", F.coalesce(own, F.col("_industry"))).drop("_industry")


def attach_industry(df: DataFrame, industry: DataFrame) -> DataFrame:
    """Daily industry where the table has no industry column."""
    if "industry" in df.columns:
        return df
    return df.join(industry.select("stock_code", "trade_date", "industry"), ["stock_code", "trade_date"], "left")


def combine_on_keys(tables: Sequence[DataFrame], keys: Sequence[str] = ("stock_code", "trade_date")) -> DataFrame:
    """Full outer join of factor tables; the same factor in two tables is an error."""
    seen: set[str] = set()
    for t in tables:
        names = set(t.columns) - set(keys)
        if names & seen:
            raise ValueError(f"duplicate factor columns: {sorted(names & seen)}")
        seen |= names
    return reduce(lambda a, b: a.join(b, list(keys), "full"), tables)


def in_all(tables: Sequence[DataFrame], key: str = "sample_id") -> DataFrame:
    """Keys present in every table."""
    return reduce(DataFrame.intersect, [t.select(F.col(key).cast("string").alias(key)) for t in tables])


def bucket_means_with_fallback(
    df: DataFrame,
    small: Sequence[str],
    large: Sequence[str],
    values: dict[str, Column | str],
    count: str,
    min_rows: int = 5
) -> DataFrame:
    """Means over a row's small bucket, or over its large one if the small has too few rows.

    ``large`` keys are among the ``small`` keys. ``count`` names the row count column.
    """
    work = settled(df)
    sums = [F.sum(col(v)).alias(f"_sum_{o}") for o, v in values.items()] + [F.count(col(v)).alias(f"_count_{o}") for o, v in values.items()]
    own = work.groupBy(*small).agg(F.count(F.lit(1)).alias("_n"), *sums)
    # the large buckets are sums of small ones, so the rows are read once
    parts = ["_n", *[f"_{kind}_{o}" for kind in ("sum", "count") for o in values]]
    wide = own.groupBy(*large).agg(*[F.sum(c).alias(f"_all{c}") for c in parts])
    both = null_safe_join(own, wide, large)
    enough = F.col("_n") >= min_rows
    pick = lambda c: F.when(enough, F.col(c)).otherwise(F.col(f"_all{c}"))
    means = {o: F.try_divide(pick(f"_sum_{o}"), pick(f"_count_{o}")) for o in values}
    both = both.select(*small, *[m.alias(o) for o, m in means.items()], pick("_n").alias(count))
    return null_safe_join(work, freeze(both, "buckets"), small)


def price_flow_frame(price: DataFrame, flow: DataFrame) -> DataFrame:
    """Price rows with money flow and its three ratios to the traded amount."""
    work = price.join(flow.drop("industry"), ["stock_code", "trade_date"], "left")
    n = number
    main = n("buy_lg_amount") + n("buy_elg_amount") - n("sell_lg_amount") - n("sell_elg_amount")
    small = n("sell_sm_amount") - n("buy_sm_amount")
    return work.withColumns(
        {
            "mf_net_amount_ratio": safe_div(n("net_mf_amount") * 10.0, n("amount")),
            "mf_main_net_amount_ratio": safe_div(main * 10.0, n("amount")),
            "mf_small_order_pressure": safe_div(small * 10.0, n("amount")),
        }
    )


def feature_panel(
    blocks: Sequence[DataFrame], selected: Sequence[str], sample_ids: DataFrame | None = None, strict: bool = True
) -> DataFrame:
    """Chosen feature columns from several sample tables, one row per sample.

    With ``sample_ids`` exactly those samples, otherwise every sample of any block.
    """
    selected = list(dict.fromkeys(selected))
    available = [c for b in blocks for c in b.columns if c != "sample_id"]
    missing = [c for c in selected if c not in available]
    if missing and strict:
        raise KeyError(f"features not in any block: {missing}")
    twice = sorted({c for c in selected if available.count(c) > 1})
    if twice:
        raise ValueError(f"features in more than one block: {twice}")
    parts = []
    for block in blocks:
        columns = [c for c in selected if c in block.columns]
        if columns:
            parts.append(block.select("sample_id", *columns))
    if sample_ids is not None:
        base = sample_ids.select("sample_id").distinct()
        return reduce(lambda a, b: a.join(b, "sample_id", "left"), parts, base)
    return reduce(lambda a, b: a.join(b, "sample_id", "full"), parts)


def lookback_arrays(
    panel: DataFrame,
    samples: DataFrame,
    variables: Sequence[str],
    length: int,
    asof: str = "feature_asof_date",
) -> DataFrame:
    """Per sample the last ``length`` panel rows up to its as-of date, as arrays.

    Adds for each variable an array padded on the left with 0.0, a ``<name>_mask``
    of present values, ``window_rows`` and ``full_window``. Panel rows and samples
    of one entity meet in one ordered pass, so the as-of date need not be a panel
    date. Panel rows are numbered there; the asked rows carry the number of the last one and read the rows of that
    number and the ones before it, so no array goes through a sort. Both passes are dealt out by the size of the input, so
    a task holds the same rows at any size.
    """
    stamp = F.struct(*[number(v).alias(v) for v in variables])
    points = panel.select("stock_code", F.col("trade_date").alias("_day"), stamp.alias("_v"), F.lit(0).alias("_side"))
    asked = (
        samples.select("stock_code", F.col(asof).alias("_day")).distinct()
        .withColumns({"_v": F.lit(None).cast(points.schema["_v"].dataType), "_side": F.lit(1)})
    )
    both = spread(points.unionByName(asked), "stock_code")
    so_far = Window.partitionBy("stock_code").orderBy("_day", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_n", F.count(F.when(F.col("_side") == 0, 1)).over(so_far))
    last = Window.partitionBy("stock_code").orderBy("_n").rangeBetween(1 - length, Window.currentRow)
    seen = both.withColumn("_w", F.collect_list("_v").over(last)).where((F.col("_side") == 1) & (F.col("_n") > 0))
    work = spread(samples, "stock_code", asof).join(
        seen.select("stock_code", F.col("_day").alias(asof), "_w"), ["stock_code", asof], "left"
    ).withColumn("window_rows", F.coalesce(F.size("_w"), F.lit(0)))
    work = work.withColumn("window_rows", F.greatest(F.col("window_rows"), F.lit(0)))
    pad = F.lit(length) - F.col("window_rows")
    results = {"full_window": F.col("window_rows") >= length}
    for v in variables:
        values = F.coalesce(F.transform("_w", lambda r: r[v]), F.array().cast("array<double>"))
        results[v] = F.concat(
            F.array_repeat(F.lit(0.0), pad), F.transform(values, lambda x: F.coalesce(x, F.lit(0.0)))
        )
        results[f"{v}_mask"] = F.concat(F.array_repeat(F.lit(False), pad), F.transform(values, lambda x: x.isNotNull()))
    return work.withColumns(results).drop("_w")
