"""Cross-sectional operators per date."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions import scalar as sc
from tidepanel.operators import cross_section as cs
from tidepanel.operators import timeseries as ts
from tidepanel.registry import tables
from tidepanel.registry.base import query, rounded, tidy
from tidepanel.registry.tables import sql

KEYS = ["stock_code", "trade_date"]
DAY = "PARTITION BY trade_date"
TARGET = "PARTITION BY target_trade_date"


def avg_rank(x: str, by: str = DAY, order: str = "ASC") -> str:
    """Average-tie rank in SQL: rank plus half the number of other peers."""
    return (
        f"CASE WHEN {x} IS NOT NULL THEN rank() OVER ({by} ORDER BY {x} {order} NULLS LAST) + "
        f"(count(*) OVER ({by}, {x}) - 1) / 2 END"
    )


def robust_sql(source: str, out: str, columns: dict[str, str], by: str = "target_trade_date") -> str:
    """CTEs ``out`` with robust z-scores of expressions over ``source``."""
    part = f"PARTITION BY {by}"
    raw = ", ".join(f"{e} AS x_{c}" for c, e in columns.items())
    med = ", ".join(f"quantile_cont(x_{c}, 0.5) OVER ({part}) AS m_{c}" for c in columns)
    mad = ", ".join(
        f"quantile_cont(abs(x_{c} - m_{c}), 0.5) OVER ({part}) AS a_{c}, stddev_samp(x_{c}) OVER ({part}) AS s_{c}"
        for c in columns
    )
    z = ", ".join(
        f"greatest(least(coalesce((x_{c} - m_{c}) / coalesce(nullif(1.4826 * a_{c}, 0), nullif(s_{c}, 0)), 0), 4), -4) AS {c}"
        for c in columns
    )
    drop = ", ".join(f"{p}_{c}" for c in columns for p in "xmas")
    return f"""{out}_1 AS (SELECT *, {raw} FROM {source}),
{out}_2 AS (SELECT *, {med} FROM {out}_1),
{out}_3 AS (SELECT *, {mad} FROM {out}_2),
{out} AS (SELECT * EXCLUDE ({drop}), {z} FROM {out}_3)"""


@query(
    "cs_rank",
    sql(
        "gappy",
        f"SELECT stock_code, trade_date, {rounded(['rx', 'rt', 'rt_desc'])} FROM (SELECT *, {avg_rank('x')} AS rx, "
        f"{avg_rank('t')} AS rt, {avg_rank('t', order='DESC')} AS rt_desc FROM gappy)",
    ),
)
def cs_rank(spark, sf):
    """Average-tie ranks per month, up and down."""
    df = cs.cs_rank(tables.gappy(spark, sf), {"rx": "x", "rt": "t"})
    df = cs.cs_rank(df, {"rt_desc": "t"}, ascending=False)
    return tidy(df.select(*KEYS, "rx", "rt", "rt_desc"))


@query(
    "cs_pct_rank",
    sql(
        "gappy",
        f"SELECT stock_code, trade_date, {rounded(['px', 'pt'])} FROM (SELECT *, "
        f"({avg_rank('x')}) / count(x) OVER ({DAY}) AS px, ({avg_rank('t')}) / count(t) OVER ({DAY}) AS pt FROM gappy)",
    ),
)
def cs_pct_rank(spark, sf):
    """Percentile ranks per month."""
    df = cs.cs_pct_rank(tables.gappy(spark, sf), {"px": "x", "pt": "t"})
    return tidy(df.select(*KEYS, "px", "pt"))


@query(
    "mean_rank",
    sql(
        "gappy",
        f"""SELECT stock_code, trade_date, {rounded(['m3', 'p'])} FROM (
          SELECT *, ({avg_rank('m3')}) / count(m3) OVER ({DAY}) AS p FROM (
            SELECT *, CASE WHEN count(x) OVER w >= 3 THEN avg(x) OVER w END AS m3 FROM gappy
            WINDOW w AS (PARTITION BY stock_code ORDER BY trade_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)))""",
    ),
)
def mean_rank(spark, sf):
    """Flagship: a rolling mean per entity, then its percentile rank per month."""
    df = tables.gappy(spark, sf).withColumn("m3", ts.ts_mean("x", 3))
    return tidy(cs.cs_pct_rank(df, {"p": "m3"}).select(*KEYS, "m3", "p"))


@query(
    "cs_zscore",
    sql(
        "gappy",
        f"""SELECT stock_code, trade_date, {rounded(['zx', 'zf', 'z1'])} FROM (SELECT *,
          (x - avg(x) OVER ({DAY})) / nullif(stddev_pop(x) OVER ({DAY}), 0) AS zx,
          (f - avg(f) OVER ({DAY})) / nullif(stddev_pop(f) OVER ({DAY}), 0) AS zf,
          (x - avg(x) OVER ({DAY})) / nullif(stddev_samp(x) OVER ({DAY}), 0) AS z1 FROM gappy)""",
    ),
)
def cs_zscore(spark, sf):
    """Z-scores per month; months in which all values are equal have none."""
    df = cs.cs_zscore(tables.gappy(spark, sf), {"zx": "x", "zf": "f"})
    return tidy(cs.cs_zscore(df, {"z1": "x"}, ddof=1).select(*KEYS, "zx", "zf", "z1"))


@query(
    "industry_neutralize",
    sql(
        "gappy",
        f"""SELECT stock_code, trade_date, {rounded(['nx', 'ny'])} FROM (SELECT *,
          CASE WHEN trim(industry) <> '' THEN vwap - avg(vwap) OVER (PARTITION BY trade_date, industry) END AS nx,
          CASE WHEN trim(industry) <> '' THEN y - avg(y) OVER (PARTITION BY trade_date, industry) END AS ny FROM gappy)""",
    ),
)
def industry_neutralize(spark, sf):
    """Distance to the industry mean of the month; entities without industry have none."""
    df = cs.industry_neutralize(tables.gappy(spark, sf), {"nx": "vwap", "ny": "y"})
    return tidy(df.select(*KEYS, "nx", "ny"))


@query(
    "daily_zscore",
    sql(
        "predictions",
        f"""SELECT sample_id, {rounded(['zy', 'zr'])} FROM (SELECT *,
          coalesce((y_score - avg(y_score) OVER d) / nullif(stddev_samp(y_score) OVER d, 0), 0) AS zy,
          coalesce((return_pred - avg(return_pred) OVER d) / nullif(stddev_samp(return_pred) OVER d, 0), 0) AS zr
          FROM predictions WINDOW d AS ({TARGET}))""",
    ),
)
def daily_zscore(spark, sf):
    """Score z-scores, zero where undefined."""
    df = cs.daily_zscore(
        tables.predictions(spark, sf), {"zy": "y_score", "zr": "return_pred"}
    )
    return tidy(df.select("sample_id", "zy", "zr"))


_LOGIT = "ln(greatest(least(direction_prob, 1 - 1e-6), 1e-6) / (1 - greatest(least(direction_prob, 1 - 1e-6), 1e-6)))"


@query(
    "daily_logit_zscore",
    sql(
        "predictions",
        f"""SELECT sample_id, {rounded(['z'])} FROM (SELECT *,
          coalesce((v - avg(v) OVER d) / nullif(stddev_samp(v) OVER d, 0), 0) AS z
          FROM (SELECT *, {_LOGIT} AS v FROM predictions) WINDOW d AS ({TARGET}))""",
    ),
)
def daily_logit_zscore(spark, sf):
    """Z-scores of the clipped log-odds."""
    df = cs.daily_logit_zscore(tables.predictions(spark, sf), {"z": "direction_prob"})
    return tidy(df.select("sample_id", "z"))


@query(
    "daily_robust_z",
    sql(
        "predictions",
        f"SELECT sample_id, {rounded(['zy', 'zr', 'zl'])} FROM rz",
        robust_sql("predictions", "rz", {"zy": "y_score", "zr": "return_pred", "zl": "label_next_open_return"}),
    ),
)
def daily_robust_z(spark, sf):
    """Median-based z-scores, clipped at four."""
    columns = {"zy": "y_score", "zr": "return_pred", "zl": "label_next_open_return"}
    df = cs.robust_z(tables.predictions(spark, sf), columns)
    return tidy(df.select("sample_id", *columns))


def bin_sql(x: str, bins: int, by: str = TARGET) -> str:
    share = f"({avg_rank(x, by)}) / count({x}) OVER ({by})"
    return f"CAST(CASE WHEN {x} IS NULL THEN -1 ELSE floor(least({share}, 0.999999) * {bins}) END AS INTEGER)"


@query(
    "daily_quantile_bin",
    sql(
        "predictions",
        f"SELECT sample_id, {bin_sql('y_score', 4)} AS b4, {bin_sql('return_pred', 3)} AS b3 FROM predictions",
    ),
)
def daily_quantile_bin(spark, sf):
    """Quantile bins per day, -1 for a missing value."""
    df = cs.quantile_bin(
        tables.predictions(spark, sf), {"b4": ("y_score", 4), "b3": ("return_pred", 3)}
    )
    return df.select("sample_id", "b4", "b3")


@query(
    "daily_median_fill",
    sql(
        "gappy",
        f"""SELECT stock_code, trade_date, {rounded(['x', 'y', 't'])} FROM (SELECT stock_code, trade_date,
          coalesce(x, quantile_cont(x, 0.5) OVER ({DAY})) AS x, coalesce(y, quantile_cont(y, 0.5) OVER ({DAY})) AS y,
          coalesce(t, quantile_cont(t, 0.5) OVER ({DAY})) AS t FROM gappy)""",
    ),
)
def daily_median_fill(spark, sf):
    """Gaps filled with the month's median."""
    df = cs.median_fill(tables.gappy(spark, sf), ["x", "y", "t"])
    return tidy(df.select(*KEYS, "x", "y", "t"))


@query(
    "daily_quantile_floor",
    sql(
        "predictions",
        f"""SELECT sample_id, CASE WHEN return_pred >= quantile_cont(return_pred, 0.05) OVER ({TARGET})
          THEN 1.0 ELSE 0.0 END::DOUBLE AS above FROM predictions""",
    ),
)
def daily_quantile_floor(spark, sf):
    """Flag of values at or above the day's 5% quantile."""
    df = cs.quantile_floor_flag(tables.predictions(spark, sf), "return_pred", 0.05, "above")
    return df.select("sample_id", "above")


def first_rank_sql(x: str, order: str = "DESC", by: str = TARGET, row_id: str = "sample_id") -> str:
    return (
        f"CASE WHEN {x} IS NOT NULL THEN CAST(row_number() OVER ({by} ORDER BY {x} {order} NULLS LAST, {row_id}) "
        "AS INTEGER) END"
    )


@query(
    "first_come_rank",
    sql(
        "predictions",
        f"SELECT sample_id, {first_rank_sql('y_score')} AS rank, {first_rank_sql('y_score', 'ASC')} AS worst FROM predictions",
    ),
)
def first_come_rank(spark, sf):
    """Row numbers by score, ties by sample id."""
    df = cs.first_rank(tables.predictions(spark, sf), "y_score")
    return cs.first_rank(df, "y_score", "worst", ascending=True).select("sample_id", "rank", "worst")


@query(
    "top_floor_guard",
    sql(
        "predictions",
        f"""SELECT sample_id, round(CASE WHEN direction_prob < 0.4 AND g_price < 0.5
            THEN least(final_score, coalesce(floor40, -1e9) - 1e-6) ELSE final_score END, 6) + 0 AS score
          FROM predictions JOIN (SELECT target_trade_date, min(final_score) AS floor40 FROM (
            SELECT *, row_number() OVER ({TARGET} ORDER BY final_score DESC, sample_id) AS n FROM predictions)
            WHERE n <= 40 GROUP BY 1) USING (target_trade_date)""",
    ),
)
def top_floor_guard(spark, sf):
    """Guarded rows are held below the day's 40th score."""
    guard = (F.col("direction_prob") < 0.4) & (F.col("g_price") < 0.5)
    df = tables.predictions(spark, sf).withColumn("score", F.col("final_score"))
    df = cs.top_floor_guard(df, "score", guard)
    return tidy(df.select("sample_id", "score"))


@query(
    "daily_excess",
    sql(
        "predictions",
        f"""SELECT sample_id, round(label_next_open_return - avg(label_next_open_return) OVER ({TARGET}), 6) + 0 AS excess
          FROM predictions""",
    ),
)
def daily_excess(spark, sf):
    """Label minus the day's mean label."""
    df = cs.daily_excess(tables.predictions(spark, sf), {"excess": "label_next_open_return"})
    return tidy(df.select("sample_id", "excess"))


@query(
    "direction_label",
    sql(
        "predictions",
        f"""SELECT sample_id, CASE WHEN n > 0 THEN CASE WHEN v > z THEN 1.0 ELSE 0.0 END END::DOUBLE AS direction_target,
          coalesce(abs(v) > z, false) AS direction_valid
          FROM (SELECT *, greatest(0.001, 0.25 * stddev_pop(v) OVER ({TARGET})) AS z, count(v) OVER ({TARGET}) AS n
            FROM (SELECT *, label_next_open_return AS v FROM predictions))""",
    ),
)
def direction_label(spark, sf):
    """Up label beyond a dead zone of a quarter deviation."""
    df = cs.direction_label(
        tables.predictions(spark, sf), "label_next_open_return", fixed_epsilon=0.001, std_fraction=0.25,
        
    )
    return df.select("sample_id", "direction_target", "direction_valid")


@query(
    "blended_label",
    sql(
        "predictions",
        f"""SELECT sample_id, {rounded(['none', 'part', 'full_b'])} FROM (SELECT sample_id, a AS none,
          coalesce(a * 0.7 + b * 0.3, a, b) AS part, coalesce(b, a) AS full_b
          FROM (SELECT sample_id, label_next_open_return AS a, label_next_vwap_return AS b FROM predictions))""",
    ),
)
def blended_label(spark, sf):
    """Two labels blended, one standing in for the other."""
    a, b = "label_next_open_return", "label_next_vwap_return"
    return tidy(
        tables.predictions(spark, sf).select(
            "sample_id",
            cs.blend_labels(a, b, 0.0).alias("none"),
            cs.blend_labels(a, b, 0.3).alias("part"),
            cs.blend_labels(a, b, 1.0).alias("full_b"),
        )
    )


@query(
    "trend_adjusted_label",
    sql(
        "context_predictions",
        """SELECT sample_id, round(v + 0.5 * greatest(least(coalesce(context_h, 0), 1), 0) * greatest(v, 0)
            - 0.3 * context_oh * greatest(-v, 0) - 0.2 * context_br * greatest(-v, 0), 6) + 0 AS label
          FROM (SELECT *, label_next_open_return AS v FROM context_predictions WHERE label_next_open_return IS NOT NULL)
          UNION ALL SELECT sample_id, NULL FROM context_predictions WHERE label_next_open_return IS NULL""",
    ),
)
def trend_adjusted_label(spark, sf):
    """Label lifted by health, lowered by overheat and break."""
    label = cs.trend_adjusted_label(
        "label_next_open_return", "context_h", "context_oh", "context_br", 0.5, 0.3, 0.2
    )
    return tidy(tables.context_predictions(spark, sf).select("sample_id", label.alias("label")))


@query(
    "sample_time_weights",
    sql(
        "predictions",
        """SELECT sample_id, round(w / avg(w) OVER (), 6) + 0 AS time_weight FROM (SELECT sample_id,
          CASE WHEN target_trade_date >= DATE '1999-06-01' AND target_trade_date <= DATE '2000-06-01' THEN 3.0
               WHEN target_trade_date >= DATE '1998-01-01' THEN 2.0
               WHEN target_trade_date <= DATE '1996-01-01' THEN 0.5 ELSE 1.0 END::DOUBLE AS w FROM predictions)""",
    ),
)
def sample_time_weights(spark, sf):
    """Sample weights by date range, a later rule winning, divided by their mean."""
    rules = [
        {"end": "1996-01-01", "weight": 0.5},
        {"start": "1998-01-01", "weight": 2.0},
        {"start": "1999-06-01", "end": "2000-06-01", "weight": 3.0},
    ]
    return tidy(cs.time_weights(tables.predictions(spark, sf), rules).select("sample_id", "time_weight"))


@query(
    "winsorize",
    sql(
        "gappy",
        f"""SELECT stock_code, trade_date, {rounded(['wx', 'wt'])} FROM (SELECT stock_code, trade_date,
          CASE WHEN x IS NOT NULL THEN greatest(least(x, x99), x01) END AS wx,
          CASE WHEN t IS NOT NULL THEN greatest(least(t, t95), t05) END AS wt
          FROM gappy, (SELECT quantile_cont(x, 0.01) AS x01, quantile_cont(x, 0.99) AS x99,
            quantile_cont(t, 0.05) AS t05, quantile_cont(t, 0.95) AS t95 FROM gappy))""",
    ),
)
def winsorize(spark, sf):
    """Values limited to quantiles of the whole table."""
    df = cs.winsorize(tables.gappy(spark, sf), {"wx": "x"})
    return tidy(cs.winsorize(df, {"wt": "t"}, 0.05, 0.95).select(*KEYS, "wx", "wt"))


_SCALARS = {
    "div": "y / nullif(t, 0)",
    "log": "CASE WHEN t - 3 > 0 THEN ln(t - 3) END",
    "root": "CASE WHEN t - 3 >= 0 THEN sqrt(t - 3) END",
    "log1": "CASE WHEN t - 5 > -1 THEN ln(t - 4) END",
    "clipped": "CASE WHEN x < 1000 THEN 1000 WHEN x > 5000 THEN 5000 ELSE x END",
    "sgn": "sign(t - 2)::DOUBLE",
    "product": "x * y * 0.001",
    "squash": "CASE WHEN t IS NOT NULL THEN 1 / (1 + exp(-greatest(least(t - 5, 20), -20))) END",
    "odds": "CASE WHEN t IS NOT NULL THEN ln(greatest(least(t / 40, 1 - 1e-6), 1e-6) / (1 - greatest(least(t / 40, 1 - 1e-6), 1e-6))) END",
    "avg3": "CASE WHEN x IS NOT NULL OR y IS NOT NULL OR t IS NOT NULL THEN (coalesce(x, 0) + coalesce(y, 0) + coalesce(t, 0)) "
    "/ ((x IS NOT NULL)::INT + (y IS NOT NULL)::INT + (t IS NOT NULL)::INT) END",
    "no_inf": "CASE WHEN mno % 5 = 0 THEN NULL WHEN mno % 7 = 0 THEN NULL ELSE x END",
}


@query(
    "scalar_functions",
    sql(
        "gappy",
        f"""SELECT stock_code, trade_date, {rounded(list(_SCALARS))} FROM (SELECT stock_code, trade_date,
          {", ".join(f"{e} AS {n}" for n, e in _SCALARS.items())} FROM gappy)""",
    ),
)
def scalar_functions(spark, sf):
    """Safe arithmetic, logs and roots, clipping, log-odds, row means."""
    c = F.col
    odd = F.when(c("mno") % 5 == 0, float("inf")).when(c("mno") % 7 == 0, float("nan")).otherwise(c("x"))
    return tidy(
        tables.gappy(spark, sf).select(
            *KEYS,
            sc.safe_div("y", "t").alias("div"),
            sc.safe_log(c("t") - 3).alias("log"),
            sc.safe_sqrt(c("t") - 3).alias("root"),
            sc.safe_log1p(c("t") - 5).alias("log1"),
            sc.clip("x", 1000, 5000).alias("clipped"),
            sc.sign(c("t") - 2).alias("sgn"),
            sc.interaction("x", "y", F.lit(0.001)).alias("product"),
            sc.sigmoid(c("t") - 5).alias("squash"),
            sc.logit(c("t") / 40).alias("odds"),
            sc.row_mean(["x", "y", "t"]).alias("avg3"),
            sc.finite(odd).alias("no_inf"),
        )
    )
