"""Operators within one date (or any other group) across entities.

All take a DataFrame and return it with columns added. Means and deviations are grouped aggregates with partial
aggregation, joined back by group; ranks, quantiles and row numbers are the exact positions of
:mod:`tidepanel.operators.ordered`, which cut a group where it is large. So no section has to fit in one task, and there is
one plan for every size. Statistics of groups are stored before they are joined back, so that Spark knows their size and does
not shuffle the rows for a small table. An operator that reads its input more than once stores it first, unless it only projects,
filters and joins such small tables to stored rows already.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalar import clip, col, finite, flag, logit, safe_div
from tidepanel.operators.ordered import add_ranks, exact_quantiles, median_of_distances, number_rows, rank_edges
from tidepanel.scale import freeze, null_safe_join, settled

BY = ("trade_date",)
TARGET = ("target_trade_date",)
ROBUST_SCALE = 1.4826
LOWEST_SCORE = -1e9


def average_rank(x: Column | str, by: Sequence[str] = BY, ascending: bool = True) -> Column:
    """Rank with ties averaged, as a window expression."""
    x = col(x)
    ordered = Window.partitionBy(*by).orderBy(x.asc_nulls_last() if ascending else x.desc_nulls_last())
    peers = ordered.rangeBetween(Window.currentRow, Window.currentRow)
    return F.when(x.isNotNull(), F.rank().over(ordered) + (F.count(x).over(peers) - 1) / 2.0)


def pct_rank(x: Column | str, by: Sequence[str] = BY, ascending: bool = True) -> Column:
    """Average rank divided by the number of present values."""
    return average_rank(x, by, ascending) / F.count(col(x)).over(Window.partitionBy(*by))


def cs_rank(
    df: DataFrame,
    ranks: Mapping[str, str],
    by: Sequence[str] = BY,
    ascending: bool = True,
    share: bool = False,
    row: Sequence[str] | None = None,
) -> DataFrame:
    """Add average-tie ranks ``{out: column}``; with ``share`` percentile ranks. ``row``: columns that name a row, if known."""
    values = {f"_x_{out}": finite(x) for out, x in ranks.items()}
    ranked = add_ranks(df.withColumns(values), by, {out: f"_x_{out}" for out in ranks}, ascending, share, row)
    return ranked.drop(*values)


def cs_pct_rank(df, ranks, by: Sequence[str] = BY, ascending: bool = True, row: Sequence[str] | None = None) -> DataFrame:
    return cs_rank(df, ranks, by, ascending, share=True, row=row)


def group_values(
    df: DataFrame, by: Sequence[str], aggregates: Mapping[str, Column], source: DataFrame | None = None
) -> DataFrame:
    """Add aggregates of the row's group as columns; ``source``: a settled table that ``df`` was made from, to aggregate instead."""
    work = df if source is not None else settled(df)
    stats = (work if source is None else source).groupBy(*by).agg(*[a.alias(out) for out, a in aggregates.items()])
    return null_safe_join(work, freeze(stats, "groups"), by)


def zscore(
    df: DataFrame,
    columns: Mapping[str, Column | str],
    by: Sequence[str] = BY,
    ddof: int = 0,
    fill: float | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add ``(x - mean) / std`` per group; NULL (or ``fill``) where the deviation is zero or unknown."""
    spread = F.stddev_pop if ddof == 0 else F.stddev_samp
    values = {f"_x_{out}": finite(x) for out, x in columns.items()}
    work = df.withColumns(values)
    stats = {}
    for out in columns:
        stats[f"_m_{out}"] = F.avg(f"_x_{out}")
        stats[f"_s_{out}"] = spread(f"_x_{out}")
    work = group_values(work, by, stats, None if source is None else source.withColumns(values))
    results = {}
    for out in columns:
        z = safe_div(F.col(f"_x_{out}") - F.col(f"_m_{out}"), F.col(f"_s_{out}"))
        results[out] = z if fill is None else F.coalesce(z, F.lit(float(fill)))
    return work.withColumns(results).drop(*values, *stats)


def cs_zscore(df, columns, by: Sequence[str] = BY, ddof: int = 0, source: DataFrame | None = None) -> DataFrame:
    return zscore(df, columns, by, ddof, None, source)


def daily_zscore(df, columns, by: Sequence[str] = TARGET) -> DataFrame:
    """Score form: one degree of freedom, zero where undefined."""
    return zscore(df, columns, by, 1, 0.0)


def daily_logit_zscore(df, columns, by: Sequence[str] = TARGET) -> DataFrame:
    return daily_zscore(df, {out: logit(x) for out, x in columns.items()}, by)


def industry_neutralize(
    df: DataFrame,
    columns: Mapping[str, str],
    industry: str = "industry",
    by: Sequence[str] = BY,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add the distance to the mean of the same date and industry; no industry, no value."""
    known = F.trim(F.col(industry)) != ""
    work = group_values(
        df, [*by, industry], {f"_m_{out}": F.avg(finite(x)) for out, x in columns.items()}, source
    )
    results = {out: finite(F.when(known, col(x) - F.col(f"_m_{out}"))) for out, x in columns.items()}
    return work.withColumns(results).drop(*[f"_m_{out}" for out in columns])


def _long(df: DataFrame, by: Sequence[str], columns: Mapping[str, Column | str], clean: bool = False) -> DataFrame:
    """One row per row and column: group, ``_out`` and the value ``_x``; ``clean`` if the columns are finite already."""
    value = (lambda x: F.col(x).cast("double")) if clean else lambda x: finite(x).cast("double")
    pairs = F.array(*[F.struct(F.lit(out).alias("_out"), value(x).alias("_x")) for out, x in columns.items()])
    return df.select(*by, F.inline(pairs))


def _pivoted(stats: DataFrame, by: Sequence[str], wanted: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row per group from a row per group and ``_out``: ``{name: (out, statistic)}``."""
    return stats.groupBy(*by).agg(*[F.max(F.when(F.col("_out") == o, F.col(s))).alias(n) for n, (o, s) in wanted.items()])


def group_quantiles(
    df: DataFrame, quantiles: Mapping[str, tuple[str, float]], by: Sequence[str] = BY
) -> DataFrame:
    """Add ``{out: (column, q)}`` quantiles of the row's group, linearly interpolated."""
    work = settled(df)
    shares = sorted({q for _, q in quantiles.values()})
    long = _long(work, by, {x: x for x, _ in quantiles.values()})
    stats = exact_quantiles(long, [*by, "_out"], "_x", {f"_q{i}": q for i, q in enumerate(shares)})
    found = _pivoted(stats, by, {out: (x, f"_q{shares.index(q)}") for out, (x, q) in quantiles.items()})
    return null_safe_join(work, freeze(found, "groups"), by)


def robust_z(
    df: DataFrame,
    columns: Mapping[str, Column | str],
    by: Sequence[str] = TARGET,
    limit: float = 4.0,
    quantiles: Mapping[str, tuple[str, float]] | None = None,
) -> DataFrame:
    """Add ``(x - median) / (1.4826 MAD)`` clipped to the limit, and ``{out: (column, q)}`` group quantiles.

    Where the median deviation is zero the standard deviation takes its place;
    where that is zero too, or x is missing, the result is zero. The statistics of all columns come from two selections over
    one long table and are joined back once.
    """
    by, wanted = list(by), dict(quantiles or {})
    values = {f"_x_{out}": finite(x) for out, x in columns.items()}
    work = settled(df.withColumns(values))
    raw = {f"_q_{out}": finite(x) for out, (x, _) in wanted.items()}
    long = _long(work.withColumns(raw) if raw else work, by, {x: x for x in (*values, *raw)}, clean=True)
    shares = sorted({0.5, *[q for _, q in wanted.values()]})
    names = {f"_q{i}": q for i, q in enumerate(shares)}
    middle = exact_quantiles(long, [*by, "_out"], "_x", names, {"_s": F.stddev_samp("_x")}, "_grid")
    median = f"_q{shares.index(0.5)}"
    spread = median_of_distances(long, [*by, "_out"], "_x", middle, median, "_grid", "_a")
    stats = {f"_m{x}": (x, median) for x in values} | {f"_s{x}": (x, "_s") for x in values} | {f"_a{x}": (x, "_a") for x in values}
    found = _pivoted(spread, by, stats | {out: (f"_q_{out}", f"_q{shares.index(q)}") for out, (_, q) in wanted.items()})
    # the divisor is made per group, and the quotient is a column of its own, so that no row's expression is written twice
    nonzero = lambda n: F.nullif(n, F.lit(0.0))
    scales = {f"_s{x}": F.coalesce(nonzero(F.lit(ROBUST_SCALE) * F.col(f"_a{x}")), nonzero(F.col(f"_s{x}"))) for x in values}
    found = found.withColumns(scales).drop(*[f"_a{x}" for x in values])
    work = null_safe_join(work, freeze(found, "groups"), by)
    work = work.withColumns({x: (F.col(x) - F.col(f"_m{x}")) / F.col(f"_s{x}") for x in values})
    limited = lambda z: F.greatest(F.least(F.coalesce(finite(z), F.lit(0.0)), F.lit(limit)), F.lit(-limit))
    return work.withColumns({out: limited(f"_x_{out}") for out in columns}).drop(*[f"{h}{x}" for x in values for h in ("", "_m", "_s")])


def quantile_bin(
    df: DataFrame,
    columns: Mapping[str, tuple[str, int]],
    by: Sequence[str] = TARGET
) -> DataFrame:
    """Add ``{out: (column, bins)}`` bins 0..bins-1 of the percentile rank, -1 for a missing value.

    A row is compared with the values where the bins of its group begin; no row is numbered or ranked for it.
    """
    values = {f"_x_{out}": finite(x) for out, (x, _) in columns.items()}
    work = settled(df.withColumns(values))
    edges = {f"_{j}_{bins}": (j, bins) for bins in sorted({b for _, b in columns.values()}) for j in range(1, bins)}
    if not edges:
        found, begins = work, {}
    else:
        stats = rank_edges(_long(work, by, {x: x for x in values}, clean=True), [*by, "_out"], "_x", edges)
        begins = {f"_begin_{out}_{j}": (f"_x_{out}", f"_{j}_{bins}") for out, (_, bins) in columns.items() for j in range(1, bins)}
        found = null_safe_join(work, freeze(_pivoted(stats, by, begins), "groups"), by)
    results = {}
    for out, (_, bins) in columns.items():
        x, passed = F.col(f"_x_{out}"), F.lit(0)
        for j in range(1, bins):
            edge = F.col(f"_begin_{out}_{j}")
            passed = passed + F.when(edge["after"], x > edge["at"]).otherwise(x >= edge["at"]).cast("int")
        results[out] = F.when(x.isNotNull(), passed).otherwise(F.lit(-1)).cast("int")
    return found.withColumns(results).drop(*values, *begins)


def median_fill(df: DataFrame, columns: Sequence[str], by: Sequence[str] = BY) -> DataFrame:
    """Replace NULLs by the median of the row's group."""
    work = group_quantiles(df, {f"_m_{c}": (c, 0.5) for c in columns}, by)
    return work.withColumns({c: F.coalesce(finite(c), F.col(f"_m_{c}")) for c in columns}).drop(
        *[f"_m_{c}" for c in columns]
    )


def quantile_floor_flag(
    df: DataFrame, x: str, q: float, out: str, by: Sequence[str] = TARGET
) -> DataFrame:
    """1.0 where x is at or above the group's q-quantile."""
    work = group_quantiles(df, {"_floor": (x, q)}, by)
    return work.withColumn(out, flag(F.col(x) >= F.col("_floor"))).drop("_floor")


def first_rank(
    df: DataFrame,
    score: str,
    out: str = "rank",
    by: Sequence[str] = TARGET,
    row_id: str = "sample_id",
    ascending: bool = False,
    missing_last: bool = False,
) -> DataFrame:
    """Number the rows of a group by score; ties go by ``row_id``.

    A missing score gets no rank, with ``missing_last`` those after all others.
    """
    value = finite(score)
    ranked = number_rows(df, by, [value.isNull(), value if ascending else -value], row_id, out)
    place = F.col(out).cast("int")
    return ranked.withColumn(out, place if missing_last else F.when(value.isNotNull(), place))


def top_rows(
    df: DataFrame, score: str, k: int, by: Sequence[str] = TARGET, row_id: str = "sample_id", ascending: bool = False
) -> DataFrame:
    """The k best rows of each group, with their ``rank``.

    A row number limited by a constant is cut down before the shuffle (each task
    keeps its own k best), so a group of any size is fine.
    """
    value = finite(score)
    order = value.asc() if ascending else value.desc()
    ranked = F.row_number().over(Window.partitionBy(*by).orderBy(order, F.col(row_id)))
    return df.where(value.isNotNull()).withColumn("rank", ranked).where(F.col("rank") <= k)


def top_floor_guard(
    df: DataFrame,
    score: str,
    guard: Column,
    k: int = 40,
    by: Sequence[str] = TARGET,
    row_id: str = "sample_id",
) -> DataFrame:
    """Push guarded rows just below the k-th best score of the group (the lowest if there are fewer)."""
    work = settled(df.withColumn("_guard", guard))
    floors = top_rows(work, score, k, by, row_id).groupBy(*by).agg(F.min(score).alias("_floor"))
    work = null_safe_join(work, floors, by)
    limit = F.coalesce(F.col("_floor"), F.lit(LOWEST_SCORE)) - 1e-6
    capped = F.when(F.col("_guard"), F.least(F.col(score), limit)).otherwise(F.col(score))
    return work.withColumn(score, capped).drop("_guard", "_floor")


def in_top(
    df: DataFrame, score: str, k: int, out: str, by: Sequence[str] = TARGET, row_id: str = "sample_id"
) -> DataFrame:
    """Mark the k best rows of each group."""
    work = settled(df)
    best = top_rows(work, score, k, by, row_id).select(*by, row_id, F.lit(True).alias(out))
    return null_safe_join(work, best, [*by, row_id]).withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def daily_excess(df: DataFrame, columns: Mapping[str, str], by: Sequence[str] = TARGET):
    """Add x minus the group mean of its present values."""
    work = group_values(df, by, {f"_m_{out}": F.avg(finite(x)) for out, x in columns.items()})
    return work.withColumns({out: finite(x) - F.col(f"_m_{out}") for out, x in columns.items()}).drop(
        *[f"_m_{out}" for out in columns]
    )


def direction_label(
    df: DataFrame,
    x: str,
    out: str = "direction_target",
    valid: str = "direction_valid",
    fixed_epsilon: float = 0.0,
    std_fraction: float = 0.0,
    by: Sequence[str] = TARGET
) -> DataFrame:
    """Up or not up beyond a dead zone, and whether x lies outside that zone at all."""
    work = group_values(
        df, by, {"_s": F.stddev_pop(finite(x)), "_n": F.count(finite(x))}
    )
    zone = F.greatest(F.lit(max(fixed_epsilon, 0.0)), F.lit(max(std_fraction, 0.0)) * F.col("_s"))
    value = finite(x)
    return work.withColumns(
        {
            out: F.when(F.col("_n") > 0, flag(value > zone)),
            valid: F.coalesce(value.isNotNull() & (F.abs(value) > zone), F.lit(False)),
        }
    ).drop("_s", "_n")


def blend_labels(primary: Column | str, secondary: Column | str, secondary_weight: float) -> Column:
    """Weighted mean of two labels; where one is missing, the other."""
    a, b = finite(primary), finite(secondary)
    w = min(max(float(secondary_weight), 0.0), 1.0)
    if w <= 0:
        return a
    if w >= 1:
        return F.coalesce(b, a)
    return F.coalesce(a * (1.0 - w) + b * w, a, b)


def trend_adjusted_label(
    label: Column | str, h: str, oh: str, br: str, positive: float, overheat: float, broken: float
) -> Column:
    """Label lifted by health on gains and lowered by overheat and break on losses."""
    label = col(label)
    unit = lambda c: clip(F.coalesce(finite(c), F.lit(0.0)), 0.0, 1.0)
    gain, loss = clip(label, lower=0.0), clip(-label, lower=0.0)
    return label + positive * unit(h) * gain - overheat * unit(oh) * loss - broken * unit(br) * loss


def time_weights(
    df: DataFrame, rules: Sequence[Mapping[str, object]], date: str = "target_trade_date", normalise: bool = True
) -> DataFrame:
    """Add ``time_weight`` from date ranges (a later rule wins), divided by its mean."""
    weight = F.lit(1.0)
    for rule in rules:
        inside = F.lit(True)
        if rule.get("start"):
            inside = inside & (F.col(date) >= F.lit(str(rule["start"])).cast("date"))
        if rule.get("end"):
            inside = inside & (F.col(date) <= F.lit(str(rule["end"])).cast("date"))
        weight = F.when(inside, F.lit(float(rule.get("weight", 1.0)))).otherwise(weight)
    work = df.withColumn("time_weight", weight)
    if not normalise:
        return work
    mean = work.agg(F.avg("time_weight").alias("m")).scalar()
    return work.withColumn("time_weight", F.when(mean > 0, F.col("time_weight") / mean).otherwise(F.col("time_weight")))


def winsorize(df: DataFrame, columns: Mapping[str, str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Add columns clipped to quantiles of the whole table."""
    if not 0 <= low <= high <= 1:
        raise ValueError("quantiles must satisfy 0 <= low <= high <= 1")
    work = settled(df)
    bounds = exact_quantiles(_long(work, [], columns), ["_out"], "_x", {"lo": low, "hi": high})
    sides = {f"_{side}_{out}": (out, side) for out in columns for side in ("lo", "hi")}
    work = work.withColumn("_bounds", _pivoted(bounds, [], sides).select(F.struct(*sides)).scalar())  # one row
    limit = lambda side, out: F.col("_bounds")[f"_{side}_{out}"]
    return work.withColumns({out: clip(finite(x), limit("lo", out), limit("hi", out)) for out, x in columns.items()}).drop("_bounds")
