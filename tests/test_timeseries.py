import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows

from tidepanel.operators import timeseries as ts

DAY = dt.date(2024, 1, 1)


def panel(spark, series):
    data = [
        (code, DAY + dt.timedelta(days=i), v) for code, values in series.items() for i, v in enumerate(values)
    ]
    return ts.with_position(spark.createDataFrame(data, "stock_code string, trade_date date, value double"))


@pytest.fixture(scope="module")
def two(spark):
    return panel(spark, {"A": [1.0, 2.0, 4.0, 8.0], "B": [4.0, 3.0, 2.0, 1.0]})


def values(df, column):
    return [r[0] for r in rows(df.select(column.alias("v"), "stock_code", "trade_date"), "stock_code", "trade_date")]


def test_lags_do_not_cross_entities(two):
    assert values(two, ts.delay("value", 1)) == [None, 1.0, 2.0, 4.0, None, 4.0, 3.0, 2.0]
    assert values(two, ts.delta("value", 1)) == [None, 1.0, 2.0, 4.0, None, -1.0, -1.0, -1.0]
    assert values(two, ts.returns("value", 2)) == [None, None, 3.0, 3.0, None, None, -0.5, pytest.approx(-2 / 3)]


def test_full_windows_only(two):
    assert values(two, ts.ts_sum("value", 3))[:4] == [None, None, 7.0, 14.0]
    assert values(two, ts.ts_mean("value", 3, 1))[:2] == [1.0, 1.5]


def test_quantile_places_and_trend(two):
    assert values(two, ts.ts_quantile("value", 3, 0.8)) == pytest.approx([None, None, 3.2, 6.4, None, None, 3.6, 2.6])
    assert values(two, ts.ts_idxmax("value", 3))[2:4] == [3.0, 3.0]
    assert values(two, ts.ts_idxmin("value", 3))[6:] == [3.0, 3.0]
    trend = ts.ts_linear_regression("value", 3)
    assert values(two, trend.slope)[2:4] == pytest.approx([1.5, 3.0])
    assert values(two, trend.rsquare)[2] == pytest.approx(0.9642857142857143)
    assert values(two, trend.residual)[2:4] == pytest.approx([1 / 6, 1 / 3])
    assert values(two, ts.decay_linear("value", 3))[2] == pytest.approx((1 + 4 + 12) / 6)


def test_rank_and_correlation(two):
    assert values(two, ts.ts_rank("value", 3))[2:4] == [1.0, 1.0]
    assert values(two, ts.ts_rank("value", 3))[6] == pytest.approx(1 / 3)
    assert values(two, ts.ts_corr("value", "_position", 3))[6] == pytest.approx(-1.0)


def test_missing_and_constant_values(spark):
    df = panel(spark, {"A": [1.0, None, 3.0, 3.0, 3.0, 3.0]})
    assert values(df, ts.ts_sum("value", 3)) == [None, None, None, None, 9.0, 9.0]
    assert values(df, ts.ts_idxmax("value", 3, 1)) == [1.0, None, None, None, 1.0, 1.0]
    trend = ts.ts_linear_regression("value", 3)
    assert values(df, trend.slope)[4] == 0.0 and values(df, trend.rsquare)[4] is None
    assert values(df, ts.ts_corr("value", "_position", 3))[5] is None
    assert values(df, ts.forward_fill("value"))[1] == 1.0


def test_window_arguments_are_checked(two):
    for bad in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            ts.ts_mean("value", bad)
    with pytest.raises(ValueError):
        ts.ts_mean("value", 3, 4)
    with pytest.raises(ValueError):
        ts.ts_quantile("value", 3, 1.5)


def test_against_pandas_rolling(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=40)
    x[[5, 6, 20]] = np.nan
    df = panel(spark, {"A": [None if math.isnan(v) else float(v) for v in x]})
    s = pd.Series(x)
    checks = {
        "std": (ts.ts_std("value", 5), s.rolling(5).std()),
        "mean": (ts.ts_mean("value", 5, 3), s.rolling(5, min_periods=3).mean()),
        "quantile": (ts.ts_quantile("value", 6, 0.3), s.rolling(6).quantile(0.3)),
        "rank": (ts.ts_rank("value", 5), s.rolling(5).rank(pct=True)),
    }
    for name, (column, expected) in checks.items():
        got = [math.nan if v is None else v for v in values(df, column)]
        assert got == pytest.approx(list(expected), nan_ok=True), name


def test_past_does_not_change_when_the_future_is_cut(spark):
    rng = np.random.default_rng(4)
    x = [float(v) for v in rng.normal(100, 5, size=30)]
    whole, cut = panel(spark, {"A": x}), panel(spark, {"A": x[:20]})
    for column in (
        ts.ts_mean("value", 5), ts.ts_rank("value", 5), ts.ts_slope("value", 5), ts.decay_linear("value", 5), ts.delta("value", 3)
    ):
        assert values(whole, column)[:20] == values(cut, column)


def test_compounding_and_drawdown(spark):
    df = panel(spark, {"A": [0.1, None, -0.5, 0.2]})
    assert values(df, ts.compounded("value")) == pytest.approx([1.1, 1.1, 0.55, 0.66])
    nav = df.withColumn("nav", ts.compounded("value"))
    assert values(nav, ts.drawdown("nav", "stock_code")) == pytest.approx([0.0, 0.0, -0.5, -0.4])


def test_price_repair(spark):
    schema = "stock_code string, trade_date date, open double, high double, low double, close double, preclose double, change double, pct_chg double"
    data = [
        ("A", DAY, 9.0, None, None, None, 10.0, 1.0, None),
        ("A", DAY + dt.timedelta(1), 9.0, None, None, None, 10.0, None, 5.0),
        ("A", DAY + dt.timedelta(2), 9.0, None, None, None, None, None, None),
        ("A", DAY + dt.timedelta(3), 8.0, 9.0, 7.0, None, 12.0, None, None),
    ]
    out = ts.repair_prices(spark.createDataFrame(data, schema))
    assert rows(out.select("trade_date", "close", "high", "low"), "trade_date") == [
        (DAY, 11.0, 11.0, 9.0),
        (DAY + dt.timedelta(1), 10.5, 10.5, 9.0),
        (DAY + dt.timedelta(2), 12.0, 12.0, 9.0),
        (DAY + dt.timedelta(3), 8.0, 9.0, 7.0),
    ]
