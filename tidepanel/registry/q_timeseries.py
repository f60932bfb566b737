"""Time-series operators on the gappy monthly panel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tidepanel.operators import timeseries as ts
from tidepanel.plans.samples import prediction_samples
from tidepanel.registry import tables
from tidepanel.registry.base import query, rounded, tidy
from tidepanel.registry.tables import sql

KEYS = ["stock_code", "trade_date"]
ENTITY = "PARTITION BY stock_code ORDER BY trade_date"


def rolling(w: int) -> str:
    return f"({ENTITY} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def gate(x: str, w: int, value: str, need: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {rolling(w)} >= {need or w} THEN {value} END"


def simple(name: str, columns: Callable, text: dict, digits: int = 6, position: bool = False) -> None:
    """Register window columns over the gappy panel with the SQL expressions they must equal."""
    body = ", ".join(f"{e} AS {c}" for c, e in text.items())
    oracle = sql(
        "gappy",
        f"SELECT stock_code, trade_date, {rounded(list(text), digits)} FROM (SELECT *, {body} FROM numbered)",
        f"numbered AS (SELECT *, row_number() OVER ({ENTITY}) AS pos FROM gappy)",
    )

    @query(name, oracle)
    def run(spark, sf):
        panel = tables.gappy(spark, sf)
        panel = ts.with_position(panel) if position else panel
        return tidy(panel.select(*KEYS, *[c.alias(n) for n, c in columns().items()]), digits)


simple(
    "delay",
    lambda: {"d1": ts.delay("x", 1), "d3": ts.delay("x", 3), "d20": ts.delay("y", 20)},
    {"d1": f"lag(x, 1) OVER ({ENTITY})", "d3": f"lag(x, 3) OVER ({ENTITY})", "d20": f"lag(y, 20) OVER ({ENTITY})"},
)
simple(
    "delta",
    lambda: {"d1": ts.delta("x", 1), "d5": ts.delta("x", 5)},
    {"d1": f"x - lag(x, 1) OVER ({ENTITY})", "d5": f"x - lag(x, 5) OVER ({ENTITY})"},
)
simple(
    "returns",
    lambda: {"r1": ts.returns("x", 1), "r10": ts.returns("x", 10), "rt": ts.returns("t", 2)},
    {
        "r1": f"x / nullif(lag(x, 1) OVER ({ENTITY}), 0) - 1",
        "r10": f"x / nullif(lag(x, 10) OVER ({ENTITY}), 0) - 1",
        "rt": f"t / nullif(lag(t, 2) OVER ({ENTITY}), 0) - 1",
    },
)
for _name, _fn, _agg, _digits in (
    ("ts_sum", ts.ts_sum, "sum", 6),
    ("ts_mean", ts.ts_mean, "avg", 6),
    ("ts_std", ts.ts_std, "stddev_samp", 6),
    ("ts_min", ts.ts_min, "min", 6),
    ("ts_max", ts.ts_max, "max", 6),
):
    simple(
        _name,
        lambda _fn=_fn: {"w3": _fn("x", 3), "w10": _fn("x", 10), "w20p10": _fn("x", 20, 10), "y5": _fn("y", 5), "f4": _fn("f", 4)},
        {
            "w3": gate("x", 3, f"{_agg}(x) OVER {rolling(3)}"),
            "w10": gate("x", 10, f"{_agg}(x) OVER {rolling(10)}"),
            "w20p10": gate("x", 20, f"{_agg}(x) OVER {rolling(20)}", 10),
            "y5": gate("y", 5, f"{_agg}(y) OVER {rolling(5)}"),
            "f4": gate("f", 4, f"{_agg}(f) OVER {rolling(4)}"),
        },
        _digits,
    )
simple(
    "ts_quantile",
    lambda: {"q80": ts.ts_quantile("x", 5, 0.8), "q20": ts.ts_quantile("x", 10, 0.2), "half": ts.ts_quantile("y", 6, 0.5, 3)},
    {
        "q80": gate("x", 5, f"quantile_cont(x, 0.8) OVER {rolling(5)}"),
        "q20": gate("x", 10, f"quantile_cont(x, 0.2) OVER {rolling(10)}"),
        "half": gate("y", 6, f"quantile_cont(y, 0.5) OVER {rolling(6)}", 3),
    },
)
for _name, _fn, _agg in (("ts_idxmax", ts.ts_idxmax, "max"), ("ts_idxmin", ts.ts_idxmin, "min")):
    simple(
        _name,
        lambda _fn=_fn: {"i5": _fn("x", 5), "i10": _fn("t", 10), "i6p2": _fn("t", 6, 2)},
        {
            c: f"CASE WHEN count({x}) OVER {rolling(w)} >= {need} AND count({x}) OVER {rolling(w)} = count(*) OVER {rolling(w)} "
            f"THEN list_position(list({x}) OVER {rolling(w)}, {_agg}({x}) OVER {rolling(w)}) END::DOUBLE"
            for c, x, w, need in (("i5", "x", 5, 5), ("i10", "t", 10, 10), ("i6p2", "t", 6, 2))
        },
    )


def _corr(x: str, y: str, w: int, need: int) -> str:
    a, b = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    varies = " AND ".join(f"min({v}) OVER {rolling(w)} < max({v}) OVER {rolling(w)}" for v in (a, b))
    return f"CASE WHEN count({a}) OVER {rolling(w)} >= {need} AND {varies} THEN corr({a}, {b}) OVER {rolling(w)} END"


simple(
    "ts_corr",
    lambda: {"xy10": ts.ts_corr("x", "y", 10), "xy20": ts.ts_corr("x", "y", 20, 8), "fy5": ts.ts_corr("f", "volume", 5)},
    {"xy10": _corr("x", "y", 10, 10), "xy20": _corr("x", "y", 20, 8), "fy5": _corr("f", "volume", 5, 5)},
)
simple(
    "ts_rank",
    lambda: {"r5": ts.ts_rank("x", 5), "r10": ts.ts_rank("t", 10, 5)},
    {
        c: f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER {rolling(w)} >= {need} THEN "
        f"(len(list_filter(list({x}) OVER {rolling(w)}, lambda v: v < {x})) + "
        f"(len(list_filter(list({x}) OVER {rolling(w)}, lambda v: v = {x})) + 1) / 2.0) / count({x}) OVER {rolling(w)} END"
        for c, x, w, need in (("r5", "x", 5, 5), ("r10", "t", 10, 5))
    },
)


def _line(x: str, w: int, kind: str, need: int | None = None) -> str:
    frame = rolling(w)
    full = (
        f"count({x}) OVER {frame} >= {need or w} AND count({x}) OVER {frame} = count(*) OVER {frame} "
        f"AND count({x}) OVER {frame} > 1"
    )
    if kind == "slope":
        return f"CASE WHEN {full} THEN regr_slope({x}, pos) OVER {frame} END"
    if kind == "r2":
        return (
            f"CASE WHEN {full} AND min({x}) OVER {frame} < max({x}) OVER {frame} "
            f"THEN regr_r2({x}, pos) OVER {frame} END"
        )
    return f"CASE WHEN {full} THEN {x} - (regr_intercept({x}, pos) OVER {frame} + regr_slope({x}, pos) OVER {frame} * pos) END"


for _name, _fn, _kind in (
    ("ts_slope", ts.ts_slope, "slope"),
    ("ts_rsquare", ts.ts_rsquare, "r2"),
    ("ts_residual", ts.ts_residual, "residual"),
):
    simple(
        _name,
        lambda _fn=_fn: {"x5": _fn("x", 5), "x20": _fn("x", 20), "f6": _fn("f", 6), "y8p4": _fn("y", 8, 4)},
        {"x5": _line("x", 5, _kind), "x20": _line("x", 20, _kind), "f6": _line("f", 6, _kind), "y8p4": _line("y", 8, _kind, 4)},
        position=True,
    )
simple(
    "ts_linear_regression",
    lambda: ts.ts_linear_regression("x", 10)._asdict(),
    {"slope": _line("x", 10, "slope"), "rsquare": _line("x", 10, "r2"), "residual": _line("x", 10, "residual")},
    position=True,
)


def _decay(x: str, w: int, need: int) -> str:
    frame = rolling(w)
    n = f"count(*) OVER {frame}"
    return (
        f"CASE WHEN count({x}) OVER {frame} >= {need} AND count({x}) OVER {frame} = {n} THEN "
        f"list_sum(list_transform(list({x}) OVER {frame}, lambda v, i: v * i)) / ({n} * ({n} + 1) / 2) END"
    )


simple(
    "decay_linear",
    lambda: {"d5": ts.decay_linear("x", 5), "d10": ts.decay_linear("y", 10), "d6p3": ts.decay_linear("x", 6, 3)},
    {"d5": _decay("x", 5, 5), "d10": _decay("y", 10, 10), "d6p3": _decay("x", 6, 3)},
    position=True,
)
def _gaps_weighed(values):
    """Sum of value times place, a gap counting as zero."""
    return F.aggregate(F.transform(values, lambda v, i: F.coalesce(v, F.lit(0.0)) * (i + 1)), F.lit(0.0), lambda s, v: s + v)


def _weighed_sql(x: str, w: int, need: int) -> str:
    over = f"OVER ({ENTITY} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    total = f"list_sum(list_transform(list({x}) {over}, lambda v, i: coalesce(v, 0) * i))"
    return f"CASE WHEN count({x}) {over} >= {need} THEN {total} END"


simple(
    "ts_apply",
    lambda: {"own5": ts.ts_apply("x", 5, _gaps_weighed), "own8p3": ts.ts_apply("y", 8, _gaps_weighed, 3)},
    {"own5": _weighed_sql("x", 5, 5), "own8p3": _weighed_sql("y", 8, 3)},
)
simple(
    "forward_fill",
    lambda: {"fx": ts.forward_fill("x"), "fy": ts.forward_fill("y")},
    {
        "fx": f"last_value(x IGNORE NULLS) OVER ({ENTITY} ROWS UNBOUNDED PRECEDING)",
        "fy": f"last_value(y IGNORE NULLS) OVER ({ENTITY} ROWS UNBOUNDED PRECEDING)",
    },
)
simple(
    "partial_windows",
    lambda: {
        "mean20": ts.ts_mean("y", 20, 10),
        "mean60": ts.ts_mean("y", 60, 30),
        "max20": ts.ts_max("high", 20, 10),
        "min20": ts.ts_min("low", 20, 10),
    },
    {
        "mean20": gate("y", 20, f"avg(y) OVER {rolling(20)}", 10),
        "mean60": gate("y", 60, f"avg(y) OVER {rolling(60)}", 30),
        "max20": gate("high", 20, f"max(high) OVER {rolling(20)}", 10),
        "min20": gate("low", 20, f"min(low) OVER {rolling(20)}", 10),
    },
)

_LABELS = ["label_next_open_return", "label_next_vwap_return"]


@query(
    "future_labels",
    sql(
        "samples",
        f"""SELECT sample_id, stock_code, feature_asof_date, target_trade_date, label_start_date, label_end_date,
        decision_ts, {rounded(_LABELS)} FROM samples""",
    ),
)
def future_labels(spark, sf):
    """Samples with labels one and two rows ahead; needs a window over each entity's months."""
    out = prediction_samples(tables.price(spark, sf))
    return tidy(
        out.select(
            "sample_id", "stock_code", "feature_asof_date", "target_trade_date", "label_start_date",
            "label_end_date", "decision_ts", *_LABELS,
        )
    )


@query(
    "compounded_index",
    sql(
        "price",
        f"""SELECT sector, trade_date, {rounded(['level', 'roc20'])} FROM (
          SELECT *, level / nullif(lag(level, 20) OVER (PARTITION BY sector ORDER BY trade_date), 0) - 1 AS roc20 FROM (
            SELECT sector, trade_date, product(1 + r) OVER (PARTITION BY sector ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS level
            FROM (SELECT sector, trade_date, coalesce(avg(r), 0) AS r FROM (
              SELECT sector, trade_date, 0.1 * (close - prev) / (close + prev) AS r FROM (
                SELECT *, lag(close) OVER ({ENTITY}) AS prev FROM price)) GROUP BY ALL)))""",
    ),
)
def compounded_index(spark, sf):
    """Sector index from mean damped returns, and its 20-period change."""
    prev = ts.delay("close", 1)
    moves = tables.price(spark, sf).withColumn("r", (F.col("close") - prev) / (F.col("close") + prev) * 0.1)
    daily = moves.groupBy("sector", "trade_date").agg(F.avg("r").alias("r"))
    level = daily.withColumn("level", ts.compounded("r", "sector"))
    return tidy(level.select("sector", "trade_date", "level", ts.returns("level", 20, "sector").alias("roc20")))


simple(
    "running_drawdown",
    lambda: {"high_water": F.max("close").over(ts.history().rowsBetween(-1_000_000, 0)), "dd": ts.drawdown("close", "stock_code")},
    {
        "high_water": f"max(close) OVER ({ENTITY} ROWS UNBOUNDED PRECEDING)",
        "dd": f"close / max(close) OVER ({ENTITY} ROWS UNBOUNDED PRECEDING) - 1",
    },
)


@query(
    "repair_prices",
    sql(
        "price",
        f"""SELECT stock_code, trade_date, {rounded(['close', 'high', 'low'])} FROM (
          SELECT stock_code, trade_date, c AS close,
            coalesce(h0, greatest(o0, preclose, c)) AS high, coalesce(l0, least(o0, preclose, c)) AS low
          FROM (SELECT *, coalesce(c0, preclose + change, preclose * (1 + pct_chg / 100),
              lead(preclose) OVER ({ENTITY}), o0) AS c FROM broken))""",
        f"""broken AS (SELECT stock_code, trade_date,
            CASE WHEN (k + mno) % 5 <> 0 THEN close END AS c0, CASE WHEN (k + mno) % 3 <> 0 THEN open END AS o0,
            CASE WHEN (k + mno) % 7 <> 0 THEN high END AS h0, CASE WHEN (k + mno) % 8 <> 0 THEN low END AS l0,
            CASE WHEN mno % 4 <> 0 THEN prev END AS preclose,
            CASE WHEN mno % 2 <> 0 THEN close - prev END AS change,
            CASE WHEN mno % 3 <> 0 THEN (close / prev - 1) * 100 END AS pct_chg
          FROM (SELECT *, lag(close) OVER ({ENTITY}) AS prev FROM price))""",
    ),
)
def repair_prices(spark, sf):
    """Close, high and low restored from what is left of a bar."""
    k, m, c = F.col("k"), F.col("mno"), F.col
    work = tables.price(spark, sf).withColumn("prev", ts.delay("close", 1))
    broken = work.select(
        *KEYS,
        F.when((k + m) % 5 != 0, c("close")).alias("close"),
        F.when((k + m) % 3 != 0, c("open")).alias("open"),
        F.when((k + m) % 7 != 0, c("high")).alias("high"),
        F.when((k + m) % 8 != 0, c("low")).alias("low"),
        F.when(m % 4 != 0, c("prev")).alias("preclose"),
        F.when(m % 2 != 0, c("close") - c("prev")).alias("change"),
        F.when(m % 3 != 0, (c("close") / c("prev") - 1) * 100).alias("pct_chg"),
    )
    return tidy(ts.repair_prices(broken).select(*KEYS, "close", "high", "low"))
