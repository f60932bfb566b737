"""Portfolio tables from ranked predictions: holdings, turnover, value, windows, orders, signals.

Holdings per day are the k best rows, found without bringing a day into one task.
What follows works on one row per day, so its ordered passes are bounded by the
number of trading days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalar import finite, number
from tidepanel.operators.cross_section import first_rank, top_rows
from tidepanel.operators.keys import on_latest_date, require_columns
from tidepanel.operators.timeseries import compounded, drawdown
from tidepanel.scale import freeze

OPEN_LABEL = "label_next_open_return"
DAY = "target_trade_date"
YEAR_DAYS = 252.0
ORDER_NOTES = {
    "buy": "manual order during 09:30-15:00; adjust price if not filled",
    "sell": "T+1 sell candidate; adjust price if not filled",
    "hold": "keep position to maintain full investment",
    "watch": "not selected today",
}


def holdings(df: DataFrame, top_n: int = 20, score: str = "y_score", row_id: str = "stock_code") -> DataFrame:
    """The best rows of each day with equal weights."""
    best = top_rows(df, score, top_n, (DAY,), row_id)
    return best.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(DAY)))


def turnover(held: DataFrame, top_n: int = 20, fee_rate: float = 0.0003, slippage_rate: float = 0.0005) -> DataFrame:
    """Names entered and left per day against the day before, their share of the book, and the cost."""
    daily = held.groupBy(DAY).agg(F.array_sort(F.collect_set("stock_code")).alias("_codes"))
    before = F.coalesce(F.lag("_codes").over(Window.orderBy(DAY)), F.array().cast("array<string>"))
    work = daily.withColumn("_before", before)
    entered, left = F.size(F.array_except("_codes", "_before")), F.size(F.array_except("_before", "_codes"))
    share = (entered + left) / float(max(top_n, 1))
    return work.select(
        DAY,
        F.size("_codes").alias("holding_count"),
        entered.alias("entered"),
        left.alias("left"),
        share.alias("turnover"),
        (share * (fee_rate + slippage_rate)).alias("cost"),
    )


def nav(held: DataFrame, moved: DataFrame, initial_cash: float = 1_000_000.0, label: str = OPEN_LABEL) -> DataFrame:
    """Gross and net return per day and the compounded value; a missing label returns zero."""
    gross = held.groupBy(DAY).agg(F.avg(F.coalesce(finite(label), F.lit(0.0))).alias("gross_return"))
    daily = gross.join(moved, DAY).withColumn("daily_return", F.col("gross_return") - F.col("cost"))
    return daily.withColumn("nav", compounded("daily_return", None, DAY) * initial_cash)


def nav_summary(values: DataFrame, initial_cash: float = 1_000_000.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Total, annualised and risk-adjusted return, largest drawdown and mean turnover, per ``keys``."""
    work = values.withColumn("_dd", drawdown("nav", list(keys) or None, DAY))
    n = F.count(F.lit(1))
    total = F.max_by("nav", DAY) / initial_cash
    r = F.coalesce(F.col("daily_return"), F.lit(0.0))
    return work.groupBy(*keys).agg(
        F.max_by("nav", DAY).alias("final_nav"),
        n.alias("day_count"),
        (total - 1.0).alias("total_return"),
        (F.pow(total, F.lit(YEAR_DAYS) / n) - 1.0).alias("annual_return"),
        (F.try_divide(F.avg(r), F.stddev_pop(r)) * F.sqrt(F.lit(YEAR_DAYS))).alias("sharpe"),
        F.min("_dd").alias("max_drawdown"),
        F.avg("turnover").alias("turnover_mean"),
    )


def date_windows(df: DataFrame, length: int, step: int = 1, most: int | None = None) -> DataFrame:
    """Windows of consecutive trading days: window_id, its first and last day, and each of its days."""
    if length <= 0 or step <= 0 or (most is not None and most <= 0):
        raise ValueError("window length, step and number must be positive")
    days = df.select(F.col(DAY).cast("date").alias(DAY)).where(F.col(DAY).isNotNull()).distinct()
    line = Window.orderBy(DAY)
    ranked = days.withColumns({"_n": F.row_number().over(line) - 1, "_all": F.count(F.lit(1)).over(Window.partitionBy())})
    # day n belongs to the windows that start at n - length + 1 .. n and fit before the last day
    last = F.least(F.col("_n"), F.col("_all") - length)
    starts = F.when(last >= 0, F.sequence(F.greatest(F.col("_n") - length + 1, F.lit(0)), last))
    member = ranked.where(last >= 0).where(F.greatest(F.col("_n") - length + 1, F.lit(0)) <= last)
    member = member.withColumn("_start", F.explode(starts)).where(F.col("_start") % step == 0)
    member = member.withColumn("window_id", (F.col("_start") / step + 1).cast("int"))
    if most is not None:
        member = member.where(F.col("window_id") <= most)
    edges = member.groupBy("window_id").agg(F.min(DAY).alias("start_date"), F.max(DAY).alias("end_date"))
    return member.select("window_id", DAY).join(edges, "window_id")


def window_values(
    held: DataFrame,
    moved: DataFrame,
    windows: DataFrame,
    top_n: int = 20,
    fee_rate: float = 0.0003,
    slippage_rate: float = 0.0005,
    label: str = OPEN_LABEL,
) -> DataFrame:
    """Value within each window, starting at one; on its first day the whole book is bought."""
    gross = held.groupBy(DAY).agg(F.avg(F.coalesce(finite(label), F.lit(0.0))).alias("gross_return"))
    daily = windows.join(gross.join(moved.drop("cost"), DAY), DAY)
    opening = F.col("holding_count") / float(max(top_n, 1))
    share = F.when(F.col(DAY) == F.col("start_date"), opening).otherwise(F.col("turnover"))
    daily = daily.withColumn("turnover", share)
    daily = daily.withColumn("daily_return", F.col("gross_return") - F.col("turnover") * (fee_rate + slippage_rate))
    return daily.withColumn("nav", compounded("daily_return", "window_id", DAY))


def window_returns(values: DataFrame) -> DataFrame:
    """Period return, drawdown and turnover of each window."""
    summary = nav_summary(values, 1.0, ("window_id", "start_date", "end_date"))
    return summary.withColumnRenamed("total_return", "period_return").drop("final_nav")


def window_summary(windows: DataFrame) -> DataFrame:
    """Distribution of window returns over all windows (one row per start day, so the median fits)."""
    r = F.col("period_return")
    return windows.agg(
        F.count(F.lit(1)).alias("window_count"),
        F.avg(r).alias("return_mean"),
        F.percentile(r, 0.5).alias("return_median"),
        F.stddev_pop(r).alias("return_std"),
        F.min(r).alias("return_min"),
        F.max(r).alias("return_max"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.count(F.when(r > 0, 1)).alias("positive_count"),
        F.count(F.when(r < 0, 1)).alias("negative_count"),
        F.min("max_drawdown").alias("max_drawdown_min"),
        F.avg("turnover_mean").alias("turnover_mean"),
    )


def equal_weight_daily(df: DataFrame, label: str = OPEN_LABEL) -> DataFrame:
    return df.groupBy(DAY).agg(F.avg(finite(label)).alias("r"))


def equal_weight_return(df: DataFrame, label: str = OPEN_LABEL) -> DataFrame:
    """Compounded mean label of all rows; a day without labels returns zero."""
    growth = F.product(F.coalesce(F.col("r"), F.lit(0.0)) + 1.0)
    return equal_weight_daily(df, label).agg((growth - 1.0).alias("period_return"))


def equal_weight_windows(df: DataFrame, length: int, label: str = OPEN_LABEL) -> DataFrame:
    """Compounded mean label of every run of ``length`` trading days."""
    run = Window.orderBy(DAY).rowsBetween(1 - length, Window.currentRow)
    growth = F.product(F.coalesce(F.col("r"), F.lit(0.0)) + 1.0).over(run)
    work = equal_weight_daily(df, label).select(
        F.col(DAY).alias("end_date"), (growth - 1.0).alias("period_return"), F.count(F.lit(1)).over(run).alias("_n")
    )
    return work.where(F.col("_n") == length).drop("_n")


def return_distribution(windows: DataFrame) -> DataFrame:
    r = F.col("period_return")
    return windows.agg(
        F.avg(r).alias("return_mean"),
        F.percentile(r, 0.5).alias("return_median"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.min(r).alias("return_min"),
    )


def recent_windows(windows: DataFrame, count: int) -> DataFrame:
    """Latest return, mean, worst and win rate of the last windows by end date."""
    recent = windows.orderBy(F.col("end_date").desc()).limit(max(count, 1)).where(F.col("period_return").isNotNull())
    r = F.col("period_return")
    return recent.agg(
        F.count(F.lit(1)).alias("recent_window_count"),
        F.max_by(r, F.col("end_date")).alias("latest_window_return"),
        F.avg(r).alias("recent_return_mean"),
        F.min(r).alias("recent_return_min"),
        F.avg((r > 0).cast("double")).alias("recent_win_rate"),
    )


# Weights of the composite score.
COMPOSITE_WEIGHTS = {
    "rolling_return_mean": 0.35,
    "recent_return_mean": 0.25,
    "rolling_excess_mean": 0.20,
    "period_excess": 0.10,
    "rolling_win_excess": 0.01,
    "max_drawdown": 0.10,
}


def composite_score(metrics: DataFrame) -> DataFrame:
    """Weighted sum of the six parts."""
    total = F.lit(0.0)
    for name, weight in COMPOSITE_WEIGHTS.items():
        total = total + F.col(name) * weight
    return metrics.withColumn("competition_score", total)


def trades(held: DataFrame, moved_weight: str = "weight") -> DataFrame:
    """Buys and sells from holdings of consecutive days: entered names buy, left names sell the next day."""
    days = held.select(DAY).distinct()
    line = Window.orderBy(DAY)
    order = days.select(DAY, F.lag(DAY).over(line).alias("_prev"), F.lead(DAY).over(line).alias("_next"))
    mine = held.select(DAY, "stock_code", moved_weight).join(order, DAY)
    keys = held.select(F.col(DAY).alias("_d"), F.col("stock_code").alias("_c"))
    buys = mine.join(keys, (F.col("_prev") == F.col("_d")) & (F.col("stock_code") == F.col("_c")), "left_anti")
    sells = mine.where(F.col("_next").isNotNull()).join(
        keys, (F.col("_next") == F.col("_d")) & (F.col("stock_code") == F.col("_c")), "left_anti"
    )
    return buys.select(DAY, "stock_code", F.lit("buy").alias("action"), F.col(moved_weight).alias("weight")).unionByName(
        sells.select(F.col("_next").alias(DAY), "stock_code", F.lit("sell").alias("action"), F.lit(0.0).alias("weight"))
    )


def daily_orders(moves: DataFrame) -> DataFrame:
    """Per day the counts, sorted code lists and ``code:weight`` list of the trades.

    Trades per day are bounded by twice the book size.
    """
    require_columns(moves, [DAY, "stock_code", "action"], "trades")
    keys = [c for c in ("window_id", "window_start_date", "window_end_date") if c in moves.columns] + [DAY]
    side = lambda action: F.array_sort(F.collect_list(F.when(F.col("action") == action, F.col("stock_code"))))
    weights = F.lit("")
    if "weight" in moves.columns:
        weighted = F.collect_list(
            F.when(F.col("action") == "buy", F.struct("stock_code", F.concat_ws(":", "stock_code", F.format_string("%.6f", "weight")).alias("t")))
        )
        weights = F.array_join(F.transform(F.array_sort(weighted), lambda w: w["t"]), ",")
    return moves.groupBy(*keys).agg(
        F.count(F.when(F.col("action") == "buy", 1)).alias("buy_count"),
        F.count(F.when(F.col("action") == "sell", 1)).alias("sell_count"),
        F.array_join(side("buy"), ",").alias("buy_stock_codes"),
        F.array_join(side("sell"), ",").alias("sell_stock_codes"),
        weights.alias("buy_weights"),
    )


SIGNAL_COLUMNS = (
    "target_trade_date", "stock_code", "stock_name", "industry", "y_score", "rank", "g_price", "g_text",
    "g_fundamental", "current_position", "suggested_action", "target_weight", "order_note",
)


def trade_signals(
    df: DataFrame,
    positions: DataFrame | None = None,
    top_n: int = 20,
    replace_k: int = 3
) -> DataFrame:
    """Action and target weight for every row of the latest day.

    Without positions the best ``top_n`` are bought. With positions the
    ``replace_k`` worst held names are sold, the best names not held are bought,
    at least ``replace_k`` and as many as the book needs to reach ``top_n``. Held
    names that are not predicted still count as kept. Names without a score rank
    after all others, for selling as for buying.
    """
    require_columns(df, (DAY, "stock_code", "y_score"), "predictions")
    day = on_latest_date(df, DAY)
    day = first_rank(day, "y_score", "rank", (DAY,), "stock_code", missing_last=True)
    held = _held(positions) if positions is not None else None
    if held is None:
        day = day.withColumn("current_position", F.lit(False))
    else:
        day = day.join(held.withColumn("current_position", F.lit(True)), "stock_code", "left")
        day = day.withColumn("current_position", F.coalesce("current_position", F.lit(False)))
        n_held = held.agg(F.count(F.lit(1)).alias("n")).scalar()
    day = freeze(day, "signals")
    # the place within held names from below, and within names not held from above
    own = day.where("current_position")
    worst = first_rank(own.select(DAY, "stock_code", "y_score"), "y_score", "_worst", (DAY,), "stock_code", True, True)
    free = day.where(~F.col("current_position"))
    best = first_rank(free.select(DAY, "stock_code", "y_score"), "y_score", "_best", (DAY,), "stock_code", False, True)
    if held is None:
        is_held, wanted, kept_size = F.lit(False), F.lit(top_n), F.lit(0)
    else:
        n_sold = F.least(own.agg(F.count(F.lit(1)).alias("n")).scalar(), F.lit(replace_k))
        is_held, kept_size = n_held > 0, n_held - n_sold
        wanted = F.when(is_held, F.greatest(F.lit(replace_k), F.lit(top_n) - kept_size)).otherwise(F.lit(top_n))
    work = day.join(worst.select("stock_code", "_worst"), "stock_code", "left").join(
        best.select("stock_code", "_best"), "stock_code", "left"
    )
    sold = F.col("current_position") & F.coalesce(F.col("_worst") <= replace_k, F.lit(False))
    bought = ~F.col("current_position") & F.coalesce(F.col("_best") <= wanted, F.lit(False))
    action = (
        F.when(sold, "sell").when(F.col("current_position"), "hold").when(bought, "buy").otherwise("watch")
    )
    n_free = free.agg(F.count(F.lit(1)).alias("n")).scalar()
    size = kept_size + F.least(wanted, n_free)
    work = work.withColumn("suggested_action", action)
    in_book = F.col("suggested_action").isin("buy", "hold")
    note = F.coalesce(*[F.when(F.col("suggested_action") == a, F.lit(t)) for a, t in ORDER_NOTES.items()])
    work = work.withColumns({"target_weight": F.when(in_book, F.lit(1.0) / size).otherwise(0.0), "order_note": note})
    missing = {c: F.lit("") if c in ("stock_name", "industry") else F.lit(0.0) for c in SIGNAL_COLUMNS if c not in work.columns}
    return work.withColumns(missing).select(*SIGNAL_COLUMNS) if missing else work.select(*SIGNAL_COLUMNS)


def _held(positions: DataFrame) -> DataFrame:
    rows = positions.where(F.coalesce(number("weight"), F.lit(0.0)) > 0) if "weight" in positions.columns else positions
    return rows.select(F.col("stock_code").cast("string").alias("stock_code")).distinct()


def buy_list(signals: DataFrame, day=None) -> DataFrame:
    """Names to buy, best first; of one day if given."""
    rows = signals.where(F.col("suggested_action") == "buy")
    if day is not None:
        rows = rows.where(F.col(DAY) == F.lit(str(day)).cast("date"))
    return rows.orderBy("rank")
