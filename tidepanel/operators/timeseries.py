"""Backward-looking operators over the rows of one entity.

Each function returns a Column, so all factors that share a window length also
share one sort and one pass. A window is the last ``w`` rows of the entity. The
result is NULL unless ``min_periods`` (default ``w``) values are present, so by
default one missing value in the window makes the result missing.

Inputs are finite numbers or NULL (see ``finite``); so are the results, short of
an overflow, which is caught where factor tables are put together. The functions
do not wrap their results themselves: Spark computes a window expression as often
as it appears, and a wrapper would repeat it.

A panel has one row per entity and date, therefore one entity holds at most as
many rows as there are dates: its window partition is bounded by the calendar,
not by the size of the raw data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidepanel.functions.scalar import col

ENTITY = "stock_code"
DATE = "trade_date"
POSITION = "_position"


def history(entity: str = ENTITY, date: str = DATE) -> WindowSpec:
    return Window.partitionBy(entity).orderBy(date)


def last_rows(w: int, entity: str = ENTITY, date: str = DATE) -> WindowSpec:
    if isinstance(w, bool) or not isinstance(w, int) or w <= 0:
        raise ValueError("window must be a positive integer")
    return history(entity, date).rowsBetween(1 - w, Window.currentRow)


def with_position(df: DataFrame, out: str = POSITION, entity: str = ENTITY, date: str = DATE) -> DataFrame:
    """Add the 1-based row number of the entity; the trend operators regress on it."""
    return df.withColumn(out, F.row_number().over(history(entity, date)).cast("double"))


def _enough(x: Column, w: int, min_periods: int | None, frame: WindowSpec) -> Column:
    need = w if min_periods is None else min_periods
    if not 0 < need <= w:
        raise ValueError("min_periods must lie between 1 and the window")
    return F.count(x).over(frame) >= need


def _complete(x: Column, w: int, min_periods: int | None, frame: WindowSpec) -> Column:
    """Enough rows and none of them missing."""
    return _enough(x, w, min_periods, frame) & (F.count(x).over(frame) == F.count(F.lit(1)).over(frame))


def ts_apply(
    x: Column | str,
    w: int,
    function: Callable[[Column], Column],
    min_periods: int | None = None,
    entity: str = ENTITY,
    date: str = DATE,
) -> Column:
    """An own function of the last ``w`` values, given as an array in order of time with gaps as NULL."""
    x, frame = col(x), last_rows(w, entity, date)
    values = F.transform(F.collect_list(F.struct(x.alias("v"))).over(frame), lambda r: r["v"])
    return F.when(_enough(x, w, min_periods, frame), function(values))


def _rolling(aggregate, x, w: int, min_periods: int | None, entity: str, date: str) -> Column:
    x, frame = col(x), last_rows(w, entity, date)
    return F.when(_enough(x, w, min_periods, frame), aggregate(x).over(frame))


def delay(x, w: int, entity: str = ENTITY, date: str = DATE) -> Column:
    last_rows(w)
    return F.lag(col(x), w).over(history(entity, date))


def delta(x, w: int, entity: str = ENTITY, date: str = DATE) -> Column:
    return col(x) - delay(x, w, entity, date)


def returns(x, w: int, entity: str = ENTITY, date: str = DATE) -> Column:
    """Relative change against ``w`` rows before; also serves as percentage change."""
    return F.try_divide(col(x), delay(x, w, entity, date)) - 1.0


def ts_sum(x, w: int, min_periods: int | None = None, entity: str = ENTITY, date: str = DATE) -> Column:
    return _rolling(F.sum, x, w, min_periods, entity, date)


def ts_mean(x, w: int, min_periods: int | None = None, entity: str = ENTITY, date: str = DATE) -> Column:
    return _rolling(F.avg, x, w, min_periods, entity, date)


def ts_std(x, w: int, min_periods: int | None = None, entity: str = ENTITY, date: str = DATE) -> Column:
    """Sample standard deviation (one degree of freedom)."""
    return _rolling(F.stddev_samp, x, w, min_periods, entity, date)


def ts_min(x, w: int, min_periods: int | None = None, entity: str = ENTITY, date: str = DATE) -> Column:
    return _rolling(F.min, x, w, min_periods, entity, date)


def ts_max(x, w: int, min_periods: int | None = None, entity: str = ENTITY, date: str = DATE) -> Column:
    return _rolling(F.max, x, w, min_periods, entity, date)


def ts_quantile(
    x, w: int, q: float, min_periods: int | None = None, entity: str = ENTITY, date: str = DATE
) -> Column:
    """Quantile with linear interpolation."""
    if not 0 <= q <= 1:
        raise ValueError("quantile must be between 0 and 1")
    return _rolling(lambda v: F.percentile(v, q), x, w, min_periods, entity, date)


def _extreme_place(pick, x, w, min_periods, entity, date) -> Column:
    x, frame = col(x), last_rows(w, entity, date)
    place = F.array_position(F.collect_list(x).over(frame), pick(x).over(frame))
    return F.when(_complete(x, w, min_periods, frame), place.cast("double"))


def ts_idxmax(x, w: int, min_periods: int | None = None, entity: str = ENTITY, date: str = DATE) -> Column:
    """1-based place of the first maximum; NULL if any value is missing."""
    return _extreme_place(F.max, x, w, min_periods, entity, date)


def ts_idxmin(x, w: int, min_periods: int | None = None, entity: str = ENTITY, date: str = DATE) -> Column:
    """1-based place of the first minimum; NULL if any value is missing."""
    return _extreme_place(F.min, x, w, min_periods, entity, date)


def ts_corr(x, y, w: int, min_periods: int | None = None, entity: str = ENTITY, date: str = DATE) -> Column:
    """Pearson correlation of the pairs with both sides present; NULL for a constant side."""
    x, y, frame = col(x), col(y), last_rows(w, entity, date)
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    moments = F.try_divide(
        F.covar_samp(x, y).over(frame), F.stddev_samp(a).over(frame) * F.stddev_samp(b).over(frame)
    )
    return F.when(_enough(a, w, min_periods, frame), moments)


def ts_rank(x, w: int, min_periods: int | None = None, entity: str = ENTITY, date: str = DATE) -> Column:
    """Share of the window at or below the current value, ties counted half-way."""
    x, frame = col(x), last_rows(w, entity, date)
    passed = lambda v: F.when(v < x, 1.0).when(v == x, 0.5).otherwise(0.0)
    below = F.aggregate(F.collect_list(x).over(frame), F.lit(0.5), lambda total, v: total + passed(v))
    return F.when(_enough(x, w, min_periods, frame) & x.isNotNull(), below / F.count(x).over(frame))


class Trend(NamedTuple):
    slope: Column
    rsquare: Column
    residual: Column


def ts_linear_regression(
    x,
    w: int,
    min_periods: int | None = None,
    position: str = POSITION,
    entity: str = ENTITY,
    date: str = DATE,
) -> Trend:
    """Least-squares line of the window against time: slope, R squared, latest residual.

    Needs the column of :func:`with_position`. A constant window has slope zero
    and no R squared.
    """
    x, t, frame = col(x), F.col(position), last_rows(w, entity, date)
    complete = _complete(x, w, min_periods, frame) & (F.count(x).over(frame) > 1)
    slope = F.regr_slope(x, t).over(frame)
    fitted = F.avg(x).over(frame) + slope * (t - F.avg(t).over(frame))
    varies = F.min(x).over(frame) < F.max(x).over(frame)
    return Trend(
        slope=F.when(complete, slope),
        rsquare=F.when(complete & varies, F.regr_r2(x, t).over(frame)),
        residual=F.when(complete, x - fitted),
    )


def ts_slope(x, w: int, min_periods: int | None = None, **names) -> Column:
    return ts_linear_regression(x, w, min_periods, **names).slope


def ts_rsquare(x, w: int, min_periods: int | None = None, **names) -> Column:
    return ts_linear_regression(x, w, min_periods, **names).rsquare


def ts_residual(x, w: int, min_periods: int | None = None, **names) -> Column:
    return ts_linear_regression(x, w, min_periods, **names).residual


def decay_linear(
    x,
    w: int,
    min_periods: int | None = None,
    position: str = POSITION,
    entity: str = ENTITY,
    date: str = DATE,
) -> Column:
    """Mean with weights 1..n, the newest row weighing most."""
    x, t, frame = col(x), F.col(position), last_rows(w, entity, date)
    rows = F.count(F.lit(1)).over(frame)
    weighted = F.sum(x * t).over(frame) - (t - rows) * F.sum(x).over(frame)
    return F.when(_complete(x, w, min_periods, frame), weighted / (rows * (rows + 1) / 2.0))


def forward_fill(x, entity: str = ENTITY, date: str = DATE) -> Column:
    """Last known value of the entity, up to and including this row."""
    so_far = history(entity, date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(col(x), ignorenulls=True).over(so_far)


def compounded(r, entity: str | Sequence[str] | None = ENTITY, date: str = DATE) -> Column:
    """Running product of ``1 + r``; a missing return counts as zero.

    Without an entity the whole table is one series: use that only on one row
    per date.
    """
    keys = [] if entity is None else [entity] if isinstance(entity, str) else list(entity)
    so_far = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.product(F.lit(1.0) + F.coalesce(col(r), F.lit(0.0))).over(so_far)


def drawdown(nav, entity: str | Sequence[str] | None = None, date: str = DATE) -> Column:
    """Distance below the running maximum."""
    keys = [] if entity is None else [entity] if isinstance(entity, str) else list(entity)
    so_far = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.try_divide(col(nav), F.max(col(nav)).over(so_far)) - 1.0


def forward_return(x, entity: str = ENTITY, date: str = DATE) -> Column:
    """Label: from the next row to the one after it. Never a feature."""
    ahead = history(entity, date)
    return F.try_divide(F.lead(col(x), 2).over(ahead), F.lead(col(x), 1).over(ahead)) - 1.0


def repair_prices(price: DataFrame, entity: str = ENTITY, date: str = DATE) -> DataFrame:
    """Fill a missing close from change, percentage change, the next row's previous close, then open.

    A missing high or low becomes the largest or smallest known of open,
    previous close and close.
    """
    next_preclose = F.lead("preclose").over(history(entity, date))
    close = F.coalesce(
        F.col("close"),
        F.col("preclose") + F.col("change"),
        F.col("preclose") * (1.0 + F.col("pct_chg") / 100.0),
        next_preclose,
        F.col("open"),
    )
    filled = price.withColumn("close", close)
    known = [F.col("open"), F.col("preclose"), F.col("close")]
    return filled.withColumns(
        {
            "high": F.coalesce(F.col("high"), F.greatest(*known)),
            "low": F.coalesce(F.col("low"), F.least(*known)),
        }
    )


__all__ = [
    "DATE",
    "ENTITY",
    "POSITION",
    "Trend",
    "compounded",
    "decay_linear",
    "delay",
    "delta",
    "drawdown",
    "forward_fill",
    "forward_return",
    "history",
    "last_rows",
    "repair_prices",
    "returns",
    "ts_corr",
    "ts_idxmax",
    "ts_idxmin",
    "ts_linear_regression",
    "ts_max",
    "ts_mean",
    "ts_min",
    "ts_quantile",
    "ts_rank",
    "ts_residual",
    "ts_rsquare",
    "ts_slope",
    "ts_std",
    "ts_sum",
    "with_position",
]
