"""Metrics of the prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import keys as ky
from tidepanel.plans import predictions as pr
from tidepanel.registry import tables
from tidepanel.registry.base import query, rounded, tidy
from tidepanel.registry.tables import sql

_PAIRS = """(SELECT *, rank() OVER (PARTITION BY target_trade_date ORDER BY x) + (count(*) OVER (PARTITION BY target_trade_date, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY target_trade_date ORDER BY y) + (count(*) OVER (PARTITION BY target_trade_date, y) - 1) / 2 AS ry
  FROM (SELECT target_trade_date, sample_id, y_score AS x, label_next_open_return AS y FROM predictions) WHERE x IS NOT NULL AND y IS NOT NULL)"""
IC_SQL = f"""ic AS (SELECT target_trade_date, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END AS rank_ic, count(*) AS pair_count
  FROM {_PAIRS} GROUP BY 1)"""


@query(
    "daily_rank_ic",
    sql("predictions", "SELECT target_trade_date, round(rank_ic, 6) + 0 AS rank_ic, pair_count FROM ic", IC_SQL),
)
def daily_rank_ic(spark, sf):
    """Rank correlation of score and label per month."""
    return tidy(pr.daily_rank_ic(tables.predictions(spark, sf)))


TOPK_SQL = """topk AS (SELECT target_trade_date, k AS topk, avg(y) FILTER (n <= k) AS topk_return, count(*) FILTER (n <= k) AS selected_count FROM (
  SELECT target_trade_date, label_next_open_return AS y, row_number() OVER (PARTITION BY target_trade_date ORDER BY y_score DESC, sample_id) AS n
  FROM predictions WHERE y_score IS NOT NULL AND label_next_open_return IS NOT NULL), (SELECT unnest([5, 10, 20]) AS k) GROUP BY ALL)"""


@query(
    "topk_returns",
    sql("predictions", "SELECT target_trade_date, topk, round(topk_return, 6) + 0 AS topk_return, selected_count FROM topk", TOPK_SQL),
)
def topk_returns(spark, sf):
    """Mean label of the 5, 10 and 20 best rows per month."""
    return tidy(pr.topk_returns(tables.predictions(spark, sf), (5, 10, 20)))


@query(
    "topk_means",
    sql("predictions", "SELECT topk, round(avg(topk_return), 6) + 0 AS return_mean FROM topk GROUP BY 1", TOPK_SQL),
)
def topk_means(spark, sf):
    """Means over the months."""
    return tidy(pr.topk_means(pr.topk_returns(tables.predictions(spark, sf), (5, 10, 20))))


def _accuracy(x: str, cut: str) -> str:
    return (
        f"(SELECT avg((({x} > {cut}) = (label_next_open_return > 0))::INT) FROM predictions "
        f"WHERE {x} IS NOT NULL AND label_next_open_return IS NOT NULL)"
    )


_MEDIAN = "(SELECT quantile_cont(y_score, 0.5) FROM predictions WHERE y_score IS NOT NULL AND label_next_open_return IS NOT NULL)"


@query(
    "direction_accuracy",
    sql(
        "predictions",
        f"SELECT 'direction_prob' AS score, round({_accuracy('direction_prob', '0.5')}, 6) + 0 AS direction_accuracy "
        f"UNION ALL SELECT 'y_score', round({_accuracy('y_score', _MEDIAN)}, 6) + 0",
    ),
)
def direction_accuracy(spark, sf):
    """Right directions of a probability and of a score against its median."""
    df = tables.predictions(spark, sf)
    parts = [
        pr.direction_accuracy(df, score=s).select(F.lit(s).alias("score"), "direction_accuracy")
        for s in ("direction_prob", "y_score")
    ]
    return tidy(parts[0].unionByName(parts[1]))


_PROB = ["direction_pred_bce", "direction_pred_accuracy", "direction_pred_up_rate", "direction_label_up_rate"]


@query(
    "probability_metrics",
    sql(
        "predictions",
        f"""SELECT {rounded(_PROB)} FROM (SELECT avg(-(u * ln(p) + (1 - u) * ln(1 - p))) AS direction_pred_bce, avg(((p > 0.5) = (u > 0))::INT) AS direction_pred_accuracy,
          avg((p > 0.5)::INT) AS direction_pred_up_rate, avg(u) AS direction_label_up_rate FROM (
          SELECT greatest(least(direction_prob, 1 - 1e-7), 1e-7) AS p, (label_next_open_return > 0)::INT AS u FROM predictions
          WHERE label_next_open_return IS NOT NULL))""",
    ),
)
def probability_metrics(spark, sf):
    """Cross entropy, accuracy and up rates."""
    return tidy(pr.probability_metrics(tables.predictions(spark, sf)))


_REG = ["mse", "mae", "bias", "pearson", "spearman", "direction_accuracy"]
_TARGETS = {
    "open": "label_next_open_return",
    "vwap": "label_next_vwap_return",
    "blend": "coalesce(label_next_open_return * 0.7 + label_next_vwap_return * 0.3, label_next_open_return, label_next_vwap_return)",
}


@query(
    "regression_metrics",
    sql(
        "predictions",
        " UNION ALL ".join(
            f"""SELECT '{t}' AS target, {rounded(_REG)} FROM (SELECT avg((x - y) * (x - y)) AS mse, avg(abs(x - y)) AS mae, avg(x - y) AS bias,
              corr(x, y) AS pearson, corr(rx, ry) AS spearman, avg(((x > 0) = (y > 0))::INT) AS direction_accuracy FROM (
              SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry
              FROM (SELECT return_pred AS x, {e} AS y FROM predictions) WHERE x IS NOT NULL AND y IS NOT NULL))"""
            for t, e in _TARGETS.items()
        ),
    ),
)
def regression_metrics(spark, sf):
    """Errors and correlations of the return head against three targets."""
    return tidy(pr.regression_metrics(tables.predictions(spark, sf), secondary_weight=0.3))


_SUMMARY = ["rank_ic_mean", "rank_ic_std", "rank_ic_ir", "direction_accuracy", "topk_return_mean"]


@query(
    "prediction_summary",
    sql(
        "predictions",
        f"""SELECT {rounded(_SUMMARY)}, day_count FROM (SELECT avg(rank_ic) AS rank_ic_mean, stddev_pop(rank_ic) AS rank_ic_std,
          avg(rank_ic) / nullif(stddev_pop(rank_ic), 0) AS rank_ic_ir, (SELECT count(DISTINCT target_trade_date) FROM predictions) AS day_count,
          {_accuracy('y_score', _MEDIAN)} AS direction_accuracy, (SELECT avg(topk_return) FROM topk WHERE topk = 20) AS topk_return_mean FROM ic)""",
        IC_SQL,
        TOPK_SQL,
    ),
)
def prediction_summary(spark, sf):
    """The headline numbers of a prediction table."""
    return tidy(pr.prediction_summary(tables.predictions(spark, sf)))


@query(
    "group_attribution",
    sql(
        "predictions",
        "SELECT \"group\", round(mean_weight, 6) + 0 AS mean_weight, round(nonzero_rate, 6) + 0 AS nonzero_rate, row_count, date_min, date_max FROM ("
        + " UNION ALL ".join(
            f"SELECT '{g}' AS \"group\", avg({e}) AS mean_weight, avg((coalesce({e}, 0) > 0)::INT) AS nonzero_rate, count({e}) AS row_count, "
            "CAST(min(target_trade_date) AS VARCHAR) AS date_min, CAST(max(target_trade_date) AS VARCHAR) AS date_max FROM predictions"
            for g, e in (("price", "g_price - 0.3"), ("text", "g_text"), ("score", "y_score"))
        )
        + ")",
    ),
)
def group_attribution(spark, sf):
    """Mean weight of feature groups."""
    df = tables.predictions(spark, sf).select(
        "target_trade_date", (F.col("g_price") - 0.3).alias("price"), F.col("g_text").alias("text"), F.col("y_score").alias("score")
    )
    return tidy(pr.group_attribution(df, ["price", "text", "score"]))


_GATES = ["g_price", "g_text", "g_fundamental"]


@query(
    "gate_attribution",
    sql(
        "predictions",
        f"SELECT year, {rounded(_GATES)} FROM (SELECT coalesce(CAST(y AS VARCHAR), 'overall') AS year, "
        + ", ".join(f"avg({g}) AS {g}" for g in _GATES)
        + " FROM (SELECT *, year(target_trade_date) AS y FROM predictions) GROUP BY ROLLUP (y))",
    ),
)
def gate_attribution(spark, sf):
    """Mean gates per year and overall."""
    return tidy(pr.gate_attribution(tables.predictions(spark, sf)))


_CHECKED = ["y_score", "final_score", "return_pred", "direction_prob", "g_price", "g_text", "g_fundamental", "label_next_open_return"]


@query(
    "prediction_sanity",
    sql(
        "predictions",
        "SELECT count(*) AS rows, count(DISTINCT target_trade_date) AS days, CAST(min(target_trade_date) AS VARCHAR) AS date_min, "
        "CAST(max(target_trade_date) AS VARCHAR) AS date_max, "
        + ", ".join(f"count(*) FILTER ({c} IS NULL) AS missing_{c}" for c in _CHECKED)
        + ", "
        + ", ".join(f"round(avg({g}), 6) + 0 AS mean_{g}" for g in _GATES)
        + " FROM predictions",
    ),
)
def prediction_sanity(spark, sf):
    """Rows, days, missing values and mean gates."""
    return tidy(pr.sanity(tables.predictions(spark, sf)))


_MARKET = """SELECT product(1 + r) - 1 AS total_return, pow(product(1 + r), 252.0 / count(*)) - 1 AS annual_return,
  avg(r) / nullif(stddev_pop(r), 0) * sqrt(252) AS sharpe, count(*) AS day_count FROM (
  SELECT target_trade_date, avg(label_next_open_return) AS r FROM predictions GROUP BY 1) WHERE r IS NOT NULL"""


@query(
    "market_baseline",
    sql("predictions", f"SELECT {rounded(['total_return', 'annual_return', 'sharpe'], 5)}, day_count FROM ({_MARKET})"),
)
def market_baseline(spark, sf):
    """Equal-weight market over all months."""
    return tidy(pr.market_baseline(tables.predictions(spark, sf)), 5)


@query(
    "run_comparison",
    sql(
        "predictions",
        """SELECT variant, """
        + ", ".join(
            f"max(CASE WHEN split = '{s}' THEN round({e}, 6) + 0 END) AS {s}_{n}"
            for s in ("validation", "holdout")
            for n, e in (("topk_return", "topk_return"), ("total_return", "total_return"), ("excess_equal_weight", "total_return - market_return"))
        )
        + """ FROM (SELECT sector AS variant, CASE WHEN target_trade_date < DATE '1999-01-01' THEN 'validation' ELSE 'holdout' END AS split,
            avg(label_next_open_return) AS topk_return, sum(label_next_open_return) AS total_return, avg(g_price) AS market_return
          FROM predictions GROUP BY ALL) GROUP BY 1""",
    ),
)
def run_comparison(spark, sf):
    """Validation and holdout metrics per variant side by side."""
    split = F.when(F.col("target_trade_date") < F.lit("1999-01-01").cast("date"), "validation").otherwise("holdout")
    runs = tables.predictions(spark, sf).groupBy(F.col("sector").alias("variant"), split.alias("split")).agg(
        F.avg("label_next_open_return").alias("topk_return"),
        F.sum("label_next_open_return").alias("total_return"),
        F.avg("g_price").alias("market_return"),
    )
    return tidy(pr.run_comparison(runs))


_W = {"q1": 0.45, "q2": 0.30, "q3": 0.125, "q4": 0.125}


def _results(spark, sf):
    """Metrics per sector (run), year (epoch) and quarter (window), with repeated evaluations."""
    d = F.col("target_trade_date")
    base = tables.predictions(spark, sf).groupBy(
        F.col("sector").alias("run"), F.year(d).cast("bigint").alias("epoch"),
        F.concat(F.lit("q"), F.quarter(d).cast("string")).alias("window"), F.pmod("k", F.lit(2)).alias("evaluated_at"),
    ).agg(F.avg("label_next_open_return").alias("a"), F.avg("g_price").alias("b"), F.avg("g_text").alias("c"))
    return base.select(
        "run", F.lit("r").alias("r_value"), "epoch", F.concat(F.lit("ckpt"), F.col("epoch").cast("string")).alias("checkpoint"),
        "window", "evaluated_at",
        F.when(F.col("window").isin("q1", "q2"), F.col("a")).alias("competition_score"),
        F.when(F.col("window") != "q4", F.col("b")).alias("period_excess_equal"),
        F.col("c").alias("period_return"),
    )


_RESULTS = """last AS (SELECT run, epoch, win, arg_max(a, e) AS a, arg_max(b, e) AS b, arg_max(c, e) AS c FROM (
    SELECT sector AS run, year(target_trade_date) AS epoch, 'q' || quarter(target_trade_date) AS win, k % 2 AS e,
      avg(label_next_open_return) AS a, avg(g_price) AS b, avg(g_text) AS c FROM predictions GROUP BY ALL) GROUP BY ALL),
parts AS (SELECT run, epoch, CASE win WHEN 'q1' THEN 0.45 WHEN 'q2' THEN 0.30 ELSE 0.125 END::DOUBLE AS w,
    CASE WHEN win IN ('q1', 'q2') THEN a WHEN win = 'q3' THEN b ELSE c END AS v FROM last),
selection AS (SELECT run, epoch, coalesce(sum(w * v) / nullif(sum(w) FILTER (v IS NOT NULL), 0), 0) AS selection_score,
    coalesce(sum(w) FILTER (v IS NOT NULL), 0) AS selection_score_weight_sum FROM parts GROUP BY ALL)"""


@query(
    "window_selection",
    sql("predictions", f"SELECT run, epoch, {rounded(['selection_score', 'selection_score_weight_sum'])} FROM selection", _RESULTS),
)
def window_selection(spark, sf):
    """Weighted score of every checkpoint over its evaluation windows."""
    out = pr.window_selection(_results(spark, sf), _W)
    return tidy(out.select("run", "epoch", "selection_score", "selection_score_weight_sum"))


@query(
    "best_checkpoint",
    sql(
        "predictions",
        "SELECT run, arg_max(epoch, selection_score) AS epoch, round(max(selection_score), 6) + 0 AS selection_score FROM selection GROUP BY 1",
        _RESULTS,
    ),
)
def best_checkpoint(spark, sf):
    """Best checkpoint of each run."""
    out = pr.best_by_run(pr.window_selection(_results(spark, sf), _W))
    return tidy(out.select("run", "epoch", "selection_score"))


# -- row selections ----------------------------------------------------------------------


@query(
    "split_filter",
    sql(
        "predictions",
        """SELECT sample_id, CASE WHEN target_trade_date <= DATE '1997-12-31' THEN 'train' WHEN target_trade_date <= DATE '1999-06-30' THEN 'validation'
          ELSE 'holdout' END AS split FROM predictions WHERE label_next_open_return IS NOT NULL""",
    ),
)
def split_filter(spark, sf):
    """Labelled samples of the three splits, the last one open."""
    ranges = {"train": ("1990-01-01", "1997-12-31"), "validation": ("1998-01-01", "1999-06-30"), "holdout": ("1999-07-01", None)}
    df = ky.with_label(tables.predictions(spark, sf), "label_next_open_return")
    parts = [ky.split_filter(df, s, ranges).select("sample_id", F.lit(s).alias("split")) for s in ranges]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "first_dates",
    sql(
        "predictions",
        "SELECT sample_id FROM predictions WHERE target_trade_date IN (SELECT DISTINCT target_trade_date FROM predictions ORDER BY 1 LIMIT 10)",
    ),
)
def first_dates(spark, sf):
    """Rows of the first ten months."""
    return ky.first_dates(tables.predictions(spark, sf), 10).select("sample_id")


@query(
    "on_listed_dates",
    sql(
        "predictions",
        "SELECT sample_id FROM predictions WHERE target_trade_date IN (SELECT date_trunc('month', o_orderdate)::DATE FROM orders WHERE o_orderpriority = '1-URGENT' AND month(o_orderdate) = 3)",
    ),
)
def on_listed_dates(spark, sf):
    """Rows of months that are in a list."""
    orders = tables.table(spark, sf, "orders").where((F.col("o_orderpriority") == "1-URGENT") & (F.month("o_orderdate") == 3))
    dates = orders.select(F.trunc("o_orderdate", "month").alias("day"))
    return ky.on_dates(tables.predictions(spark, sf), dates).select("sample_id")


@query(
    "date_range_after_windows",
    sql(
        "gappy",
        """SELECT stock_code, trade_date, round(d, 6) + 0 AS d5 FROM (SELECT *, close - lag(close, 5) OVER (PARTITION BY stock_code ORDER BY trade_date) AS d FROM gappy)
          WHERE trade_date BETWEEN DATE '1997-02-01' AND DATE '1998-02-01'""",
    ),
)
def date_range_after_windows(spark, sf):
    """A change over five rows, then one year of it: the first rows still see the year before."""
    from tidepanel.operators.timeseries import delta

    df = tables.gappy(spark, sf).withColumn("d5", delta("close", 5))
    return tidy(ky.date_range(df, "trade_date", "1997-02-01", "1998-02-01").select("stock_code", "trade_date", "d5"))


@query(
    "common_entities",
    sql(
        "price flow",
        """SELECT stock_code, count(*) AS rows FROM price WHERE stock_code IN (SELECT stock_code FROM price WHERE trade_date < DATE '1999-01-01'
          INTERSECT SELECT stock_code FROM flow WHERE buy_sm_amount > 200 ORDER BY 1 LIMIT 7) GROUP BY 1""",
    ),
)
def common_entities(spark, sf):
    """The first seven entities that two tables share."""
    price = tables.price(spark, sf)
    left, _ = ky.common_entities([price.where(F.col("trade_date") < F.lit("1999-01-01").cast("date")), tables.flow(spark, sf).where(F.col("buy_sm_amount") > 200)], 7)
    kept = left.select("stock_code").distinct()
    return price.join(kept, "stock_code", "left_semi").groupBy("stock_code").agg(F.count(F.lit(1)).alias("rows"))


_LISTED = "SELECT stock_code, trade_date FROM price WHERE close > 12 * open"


@query(
    "exclude_listed_rows",
    sql("price", f"SELECT stock_code, trade_date FROM price EXCEPT ({_LISTED})"),
)
def exclude_listed_rows(spark, sf):
    """Rows whose entity and month are not on a list."""
    price = tables.price(spark, sf)
    listed = price.where(F.col("close") > F.col("open") * 12)
    return ky.exclude_keys(price, listed).select("stock_code", "trade_date")


@query(
    "exclude_touching_samples",
    sql(
        "samples",
        f"""SELECT sample_id FROM samples s WHERE NOT EXISTS (SELECT 1 FROM ({_LISTED}) b WHERE b.stock_code = s.stock_code
          AND b.trade_date IN (s.feature_asof_date, s.target_trade_date, s.label_end_date))""",
    ),
)
def exclude_touching_samples(spark, sf):
    """Samples none of whose three dates is on the list."""
    price = tables.price(spark, sf)
    listed = price.where(F.col("close") > F.col("open") * 12)
    return ky.exclude_samples(tables.samples(spark, sf), listed).select("sample_id")


@query(
    "exclude_exchange",
    sql("price", "SELECT stock_code, trade_date FROM price WHERE NOT ends_with(stock_code, '.BJ') AND NOT contains(sector, 'ASIA')"),
)
def exclude_exchange(spark, sf):
    """Rows of all exchanges but one."""
    df = tables.price(spark, sf).withColumn("market", F.col("sector"))
    return ky.exclude_exchange(df, market_word="ASIA").select("stock_code", "trade_date")


@query(
    "keep_last",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (
      PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1""",
)
def keep_last(spark, sf):
    """One line per order and line number, the last by ship date."""
    df = tables.table(spark, sf, "lineitem")
    out = ky.keep_last(df, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "hash_sample",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(concat_ws(':', o_orderkey::VARCHAR, '20260520')), o_orderkey LIMIT 1000",
)
def hash_sample(spark, sf):
    """A thousand orders in the order of a seeded hash."""
    return ky.hash_sample(tables.table(spark, sf, "orders"), 1000, "o_orderkey").select("o_orderkey", "o_totalprice")
