"""Metrics of prediction tables, ensembles and baselines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalar import clip, correlation, finite, number, row_mean
from tidepanel.operators.cross_section import blend_labels, cs_rank, daily_zscore, first_rank, top_rows
from tidepanel.operators.joins import in_all
from tidepanel.operators.keys import keep_last, require_columns
from tidepanel.operators.ordered import exact_quantiles, add_ranks
from tidepanel.scale import freeze, null_safe_join

TARGET = ("target_trade_date",)
SCORES = ("y_score", "final_score", "return_pred")
PROBABILITIES = ("direction_prob",)
GATES = ("g_price", "g_text", "g_fundamental")
OPEN_LABEL, VWAP_LABEL = "label_next_open_return", "label_next_vwap_return"
YEAR_DAYS = 252.0


def _pairs(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.withColumns({"_x": finite(score), "_y": finite(label)})


def daily_rank_ic(
    df: DataFrame, label: str = OPEN_LABEL, score: str = "y_score"
) -> DataFrame:
    """Rank correlation of score and label per day; NULL with fewer than two pairs or a constant side."""
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    days = df.select("target_trade_date").distinct()
    rows = cs_rank(_pairs(df, score, label).where(both), {"_rx": "_x", "_ry": "_y"}, TARGET)
    varied = (F.min("_x") < F.max("_x")) & (F.min("_y") < F.max("_y"))
    stats = rows.groupBy(*TARGET).agg(
        F.when(varied, correlation(F.col("_rx"), F.col("_ry"))).alias("rank_ic"), F.count(F.lit(1)).alias("pair_count")
    )
    return null_safe_join(days, stats, TARGET).withColumn("pair_count", F.coalesce("pair_count", F.lit(0)))


def topk_returns(
    df: DataFrame, ks: Sequence[int] = (20,), label: str = OPEN_LABEL, score: str = "y_score", row_id: str = "sample_id"
) -> DataFrame:
    """Mean label of the k best rows per day, for several k in one pass over the largest k."""
    ks = [k for k in ks if k > 0]
    days = df.select("target_trade_date").distinct()
    rows = _pairs(df, score, label).where(F.col("_y").isNotNull())
    best = top_rows(rows, "_x", max(ks), TARGET, row_id)
    wanted = F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: F.col("rank") <= k))
    stats = best.select("target_trade_date", "_y", wanted.alias("topk")).groupBy("target_trade_date", "topk").agg(
        F.avg("_y").alias("topk_return"), F.count(F.lit(1)).alias("selected_count")
    )
    grid = days.withColumn("topk", F.explode(F.array(*[F.lit(k) for k in ks])))
    return null_safe_join(grid, stats, ["target_trade_date", "topk"]).withColumn(
        "selected_count", F.coalesce("selected_count", F.lit(0))
    )


def topk_means(topk: DataFrame) -> DataFrame:
    """Mean over days of each k's daily return."""
    return topk.groupBy("topk").agg(F.avg("topk_return").alias("return_mean"))


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def direction_accuracy(df: DataFrame, label: str = OPEN_LABEL, score: str = "y_score") -> DataFrame:
    """Share of rows whose predicted direction is right.

    A probability says up above one half, any other score above its median over
    the whole table.
    """
    rows = _pairs(df, score, label).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    if score == "direction_prob":
        cut = F.lit(0.5)
    else:
        rows = freeze(rows.select("_x", "_y"), "direction")
        cut = exact_quantiles(rows, [], "_x", {"median": 0.5}).select("median").scalar()
    return rows.agg(_share((F.col("_x") > cut) == (F.col("_y") > 0)).alias("direction_accuracy"))


def probability_metrics(df: DataFrame, prob: str = "direction_prob", label: str = OPEN_LABEL) -> DataFrame:
    """Cross entropy, accuracy, and up rates of probability and label."""
    rows = _pairs(df, prob, label).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    p, up = clip("_x", 1e-7, 1.0 - 1e-7), (F.col("_y") > 0).cast("double")
    loss = -(up * F.ln(p) + (1.0 - up) * F.ln(1.0 - p))
    return rows.agg(
        F.avg(loss).alias("direction_pred_bce"),
        _share((p > 0.5) == (F.col("_y") > 0)).alias("direction_pred_accuracy"),
        _share(p > 0.5).alias("direction_pred_up_rate"),
        F.avg(up).alias("direction_label_up_rate"),
    )


def regression_metrics(
    df: DataFrame, pred: str = "return_pred", secondary_weight: float = 0.0, row_id: str = "sample_id"
) -> DataFrame:
    """Errors, bias, correlations and sign accuracy against the open, vwap and blended label; one row per target."""
    targets = {"open": finite(OPEN_LABEL)}
    if VWAP_LABEL in df.columns:
        targets["vwap"] = finite(VWAP_LABEL)
        targets["blend"] = blend_labels(OPEN_LABEL, VWAP_LABEL, secondary_weight)
    else:
        targets["blend"] = finite(OPEN_LABEL)
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), y.alias("y")) for t, y in targets.items()]))
    rows = df.select(finite(pred).alias("x"), pairs.alias("_t")).select("x", "_t.target", "_t.y")
    stored = freeze(rows.where(F.col("x").isNotNull() & F.col("y").isNotNull()), "regression")
    ranked = add_ranks(stored, ["target"], {"rx": "x", "ry": "y"})
    error = F.col("x") - F.col("y")
    varied = (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    return ranked.groupBy("target").agg(
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error).alias("bias"),
        F.when(varied, correlation(F.col("x"), F.col("y"))).alias("pearson"),
        F.when(varied, correlation(F.col("rx"), F.col("ry"))).alias("spearman"),
        _share((F.col("x") > 0) == (F.col("y") > 0)).alias("direction_accuracy"),
    )


def prediction_summary(
    df: DataFrame, topk: int = 20, score: str = "y_score", row_id: str = "sample_id"
) -> DataFrame:
    """Rank IC mean, deviation and ratio, direction accuracy, top-k mean, number of days."""
    ic = daily_rank_ic(df, score=score)
    stats = ic.agg(
        F.avg("rank_ic").alias("rank_ic_mean"),
        F.stddev_pop("rank_ic").alias("rank_ic_std"),
        F.try_divide(F.avg("rank_ic"), F.stddev_pop("rank_ic")).alias("rank_ic_ir"),
        F.count(F.lit(1)).alias("day_count"),
    )
    best = topk_returns(df, (topk,), score=score, row_id=row_id).agg(F.avg("topk_return").alias("m"))
    return stats.withColumns(
        {
            "direction_accuracy": direction_accuracy(df, score=score).scalar(),
            "topk_return_mean": best.scalar(),
        }
    )


def group_attribution(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mean weight, share above zero, rows and date range of each weight column."""
    long = df.select("target_trade_date", *[number(g).alias(g) for g in groups]).unpivot(
        ["target_trade_date"], list(groups), "group", "weight"
    )
    return long.groupBy("group").agg(
        F.avg("weight").alias("mean_weight"),
        _share(F.coalesce(F.col("weight") > 0, F.lit(False))).alias("nonzero_rate"),
        F.count("weight").alias("row_count"),
        F.min("target_trade_date").cast("string").alias("date_min"),
        F.max("target_trade_date").cast("string").alias("date_max"),
    )


def gate_attribution(df: DataFrame, gates: Sequence[str] = GATES) -> DataFrame:
    """Mean gates per year and over all years."""
    present = [g for g in gates if g in df.columns]
    yearly = df.withColumn("year", F.year("target_trade_date").cast("string")).rollup("year")
    means = yearly.agg(F.grouping("year").alias("_all"), *[F.avg(g).alias(g) for g in present])
    return means.withColumn("year", F.when(F.col("_all") == 1, F.lit("overall")).otherwise(F.col("year"))).drop("_all")


def sanity(df: DataFrame, columns: Sequence[str] = (*SCORES, *PROBABILITIES, *GATES, OPEN_LABEL)) -> DataFrame:
    """Rows, days, date range, missing values per column and mean gates, in one pass."""
    present = [c for c in columns if c in df.columns]
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("target_trade_date").alias("days"),
        F.min("target_trade_date").cast("string").alias("date_min"),
        F.max("target_trade_date").cast("string").alias("date_max"),
        *[F.count(F.when(number(c).isNull(), 1)).alias(f"missing_{c}") for c in present],
        *[F.avg(g).alias(f"mean_{g}") for g in GATES if g in df.columns],
    )


def require_sane(df: DataFrame) -> None:
    row = sanity(df).first().asDict()
    bad = {k: v for k, v in row.items() if k.startswith("missing_") and v}
    if bad:
        raise ValueError(f"predictions have missing values: {bad}")


def market_baseline(df: DataFrame, label: str = OPEN_LABEL) -> DataFrame:
    """Equal-weight market over the days: total and annualised return, Sharpe ratio, days."""
    daily = df.groupBy(*TARGET).agg(F.avg(finite(label)).alias("r")).where(F.col("r").isNotNull())
    n = F.count(F.lit(1))
    total = F.product(F.col("r") + 1.0)
    return daily.agg(
        (total - 1.0).alias("total_return"),
        (F.pow(total, F.try_divide(F.lit(YEAR_DAYS), n)) - 1.0).alias("annual_return"),
        (F.try_divide(F.avg("r"), F.stddev_pop("r")) * F.sqrt(F.lit(YEAR_DAYS))).alias("sharpe"),
        n.alias("day_count"),
    )


def run_comparison(runs: DataFrame) -> DataFrame:
    """One row per variant with validation and holdout metrics side by side, and the excess over the market.

    ``runs`` has variant, split, the metrics, and market_return.
    """
    metrics = [c for c in runs.columns if c not in ("variant", "split", "market_return")]
    wide = runs.withColumn("excess_equal_weight", F.col("total_return") - F.col("market_return"))
    return wide.groupBy("variant").pivot("split", ["validation", "holdout"]).agg(
        *[F.first(c).alias(c) for c in (*metrics, "excess_equal_weight")]
    )


def single_factor_predictions(
    samples: DataFrame, factor: str, label: str = OPEN_LABEL, row_id: str = "sample_id"
) -> DataFrame:
    """A factor taken as prediction: as score, as return, and squashed as probability."""
    require_columns(samples, [factor], "baseline")
    value = number(factor)
    columns = [c for c in ("sample_id", "stock_code", "target_trade_date", factor, label) if c in samples.columns]
    work = samples.select(*columns).withColumns(
        {
            "y_score": value,
            "return_pred": value,
            "direction_prob": F.lit(1.0) / (F.exp(-F.coalesce(value, F.lit(0.0))) + 1.0),
            "g_price": F.lit(1.0),
            "g_text": F.lit(0.0),
            "g_fundamental": F.lit(0.0),
        }
    )
    return first_rank(work, "y_score", "rank", TARGET, row_id)


def ensemble(tables: Sequence[DataFrame], row_id: str = "sample_id") -> DataFrame:
    """Mean of daily z-scores, clipped probabilities and gates over samples that every table has.

    Other columns come from the first table; the rank is by the averaged final score.
    """
    for t in tables:
        require_columns(t, [row_id, "target_trade_date"], "prediction")
    shared = in_all(tables, row_id)
    everywhere = lambda names: [c for c in names if all(c in t.columns for t in tables)]
    scores, others = everywhere(SCORES), everywhere((*PROBABILITIES, *GATES))
    out = None
    for i, t in enumerate(tables):
        part = t.withColumn(row_id, F.col(row_id).cast("string")).join(shared, row_id, "left_semi")
        part = daily_zscore(part, {f"_{c}_{i}": c for c in scores}, TARGET)
        for c in others:
            value = clip(number(c), 1e-6, 1.0 - 1e-6) if c in PROBABILITIES else number(c)
            part = part.withColumn(f"_{c}_{i}", value)
        added = [f"_{c}_{i}" for c in (*scores, *others)]
        out = part if out is None else out.join(part.select(row_id, *added), row_id)
    means = {c: row_mean([f"_{c}_{i}" for i in range(len(tables))]) for c in (*scores, *others)}
    helpers = [f"_{c}_{i}" for c in (*scores, *others) for i in range(len(tables))]
    return first_rank(out.withColumns(means).drop(*helpers), "final_score", "rank", TARGET, row_id)


# Weights of the evaluation windows and the metrics to score them by, in this order.
WINDOW_WEIGHTS = {"val2026_strict": 0.45, "hold2026_recent": 0.30, "same_calendar_2025": 0.125, "same_comp_2025": 0.125}
SELECTION_METRICS = ("competition_score", "period_excess_equal", "period_return")


def window_selection(
    results: DataFrame,
    weights: Mapping[str, float] = WINDOW_WEIGHTS,
    run_columns: Sequence[str] = ("run", "r_value", "epoch", "checkpoint"),
    order: str = "evaluated_at",
) -> DataFrame:
    """Weighted score of each checkpoint over its windows.

    Of repeated results of a (run, epoch, window) the last counts. A window is
    scored by the first metric that any checkpoint has in it; weights of missing
    windows are left out of the mean.
    """
    last = keep_last(results, ["run", "epoch", "window"], [order])
    present = [m for m in SELECTION_METRICS if m in results.columns]
    wide = last.groupBy(*run_columns).pivot("window", list(weights)).agg(*[F.first(m).alias(m) for m in present])
    name = lambda w, m: f"{w}_{m}" if len(present) > 1 else w
    filled = {}
    if present:
        any_value = wide.agg(*[F.count(name(w, m)).alias(f"{w}|{m}") for w in weights for m in present]).first()
        for w in weights:
            filled[w] = next((name(w, m) for m in present if any_value[f"{w}|{m}"]), None)
    parts = {f"{w}_selection_component": F.col(c) if c else F.lit(None).cast("double") for w, c in filled.items()}
    wide = wide.withColumns(parts)
    total, used = F.lit(0.0), F.lit(0.0)
    for w, weight in weights.items():
        value = F.col(f"{w}_selection_component")
        total = total + F.coalesce(value * weight, F.lit(0.0))
        used = used + F.when(value.isNotNull(), weight).otherwise(0.0)
    return wide.withColumns({"selection_score": F.coalesce(F.try_divide(total, used), F.lit(0.0)), "selection_score_weight_sum": used})


def best_by_run(selection: DataFrame) -> DataFrame:
    """The checkpoint with the highest score of each run."""
    place = F.row_number().over(Window.partitionBy("run").orderBy(F.col("selection_score").desc_nulls_last(), "epoch", "checkpoint"))
    return selection.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")
