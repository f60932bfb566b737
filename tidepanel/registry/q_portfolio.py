"""Portfolio tables from predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators.joins import lookback_arrays, price_flow_frame
from tidepanel.plans import portfolio as po
from tidepanel.plans import samples as sm
from tidepanel.registry import tables
from tidepanel.registry.base import query, rounded, tidy
from tidepanel.registry.q_cross_section import first_rank_sql
from tidepanel.registry.tables import define, sql

N, FEE = 10, 0.0008

define(
    "book",
    f"""held AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY target_trade_date) AS weight FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY target_trade_date ORDER BY y_score DESC, stock_code) AS INTEGER) AS rank
    FROM predictions WHERE y_score IS NOT NULL) WHERE rank <= {N}),
days_list AS (SELECT target_trade_date, lag(target_trade_date) OVER (ORDER BY target_trade_date) AS prev,
    lead(target_trade_date) OVER (ORDER BY target_trade_date) AS next FROM (SELECT DISTINCT target_trade_date FROM held)),
entries AS (SELECT h.target_trade_date, h.stock_code, h.weight FROM held h JOIN days_list d USING (target_trade_date)
    WHERE NOT EXISTS (SELECT 1 FROM held b WHERE b.target_trade_date = d.prev AND b.stock_code = h.stock_code)),
exits AS (SELECT d.next AS target_trade_date, h.stock_code FROM held h JOIN days_list d USING (target_trade_date)
    WHERE d.next IS NOT NULL AND NOT EXISTS (SELECT 1 FROM held b WHERE b.target_trade_date = d.next AND b.stock_code = h.stock_code)),
turn AS (SELECT target_trade_date, h AS holding_count, coalesce(e, 0) AS entered, coalesce(x, 0) AS "left", (coalesce(e, 0) + coalesce(x, 0)) / {N}::DOUBLE AS turnover
  FROM (SELECT target_trade_date, count(*) AS h FROM held GROUP BY 1) LEFT JOIN (SELECT target_trade_date, count(*) AS e FROM entries GROUP BY 1) USING (target_trade_date)
  LEFT JOIN (SELECT target_trade_date, count(*) AS x FROM exits GROUP BY 1) USING (target_trade_date)),
book AS (SELECT t.*, gross_return, gross_return - turnover * {FEE} AS daily_return,
    1000000 * product(1 + gross_return - turnover * {FEE}) OVER (ORDER BY t.target_trade_date ROWS UNBOUNDED PRECEDING) AS nav
  FROM turn t JOIN (SELECT target_trade_date, avg(coalesce(label_next_open_return, 0)) AS gross_return FROM held GROUP BY 1) USING (target_trade_date))""",
    ("predictions",),
)


def book(spark, sf):
    held = po.holdings(tables.predictions(spark, sf), N)
    moved = po.turnover(held, N)
    return held, moved


@query("topn_holdings", sql("book", "SELECT target_trade_date, stock_code, rank, round(weight, 6) + 0 AS weight FROM held"))
def topn_holdings(spark, sf):
    """The ten best names of each month with equal weights."""
    return tidy(book(spark, sf)[0].select("target_trade_date", "stock_code", "rank", "weight"))


@query(
    "turnover_cost",
    sql(
        "book",
        f"""SELECT target_trade_date, CAST(holding_count AS INTEGER) AS holding_count, CAST(entered AS INTEGER) AS entered, CAST("left" AS INTEGER) AS "left",
          round(turnover, 6) + 0 AS turnover, round(turnover * {FEE}, 6) + 0 AS cost FROM turn""",
    ),
)
def turnover_cost(spark, sf):
    """Names entered and left per month, and what that costs."""
    return tidy(book(spark, sf)[1])


@query(
    "nav",
    sql("book", f"SELECT target_trade_date, {rounded(['gross_return', 'daily_return'])}, round(nav, 3) + 0 AS nav FROM book"),
)
def nav(spark, sf):
    """Compounded value of the book."""
    out = po.nav(*book(spark, sf)).select("target_trade_date", "gross_return", "daily_return", F.round("nav", 3).alias("nav"))
    return tidy(out)


def nav_summary_sql(source: str, cash: str, keys: str = "") -> str:
    group = f"GROUP BY {keys}" if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    head = f"{keys}, " if keys else ""
    return f"""SELECT {head}arg_max(nav, target_trade_date) AS final_nav, count(*) AS day_count, arg_max(nav, target_trade_date) / {cash} - 1 AS total_return,
      pow(arg_max(nav, target_trade_date) / {cash}, 252.0 / count(*)) - 1 AS annual_return, avg(daily_return) / nullif(stddev_pop(daily_return), 0) * sqrt(252) AS sharpe,
      min(dd) AS max_drawdown, avg(turnover) AS turnover_mean
      FROM (SELECT *, nav / max(nav) OVER ({part}ORDER BY target_trade_date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM {source}) {group}"""


_SUMMARY = ["total_return", "annual_return", "sharpe", "max_drawdown", "turnover_mean"]


@query(
    "nav_summary",
    sql("book", f"SELECT round(final_nav, 3) + 0 AS final_nav, day_count, {rounded(_SUMMARY, 5)} FROM ({nav_summary_sql('book', '1000000')})"),
)
def nav_summary(spark, sf):
    """Return, risk, drawdown and turnover of the book."""
    out = po.nav_summary(po.nav(*book(spark, sf))).withColumn("final_nav", F.round("final_nav", 3))
    return tidy(out, 5, keep=["final_nav"])


LENGTH, STEP = 6, 2
define(
    "windows",
    f"""ordered_days AS (SELECT target_trade_date, row_number() OVER (ORDER BY target_trade_date) - 1 AS n, count(*) OVER () AS total
  FROM (SELECT DISTINCT target_trade_date FROM predictions)),
starts AS (SELECT n AS s FROM ordered_days WHERE n % {STEP} = 0 AND n + {LENGTH} <= total),
windows AS (SELECT CAST(s // {STEP} + 1 AS INTEGER) AS window_id, target_trade_date, min(target_trade_date) OVER (PARTITION BY s) AS start_date,
  max(target_trade_date) OVER (PARTITION BY s) AS end_date FROM starts JOIN ordered_days ON n BETWEEN s AND s + {LENGTH - 1})""",
    ("predictions",),
)


@query("date_windows", sql("windows", "SELECT * FROM windows"))
def date_windows(spark, sf):
    """Every second run of six months."""
    return po.date_windows(tables.predictions(spark, sf), LENGTH, STEP)


define(
    "window_book",
    f"""window_book AS (SELECT *, product(1 + daily_return) OVER (PARTITION BY window_id ORDER BY target_trade_date ROWS UNBOUNDED PRECEDING) AS nav FROM (
    SELECT w.*, CASE WHEN w.target_trade_date = start_date THEN holding_count / {N}::DOUBLE ELSE turnover END AS turnover,
      gross_return - CASE WHEN w.target_trade_date = start_date THEN holding_count / {N}::DOUBLE ELSE turnover END * {FEE} AS daily_return
    FROM windows w JOIN book b USING (target_trade_date))),
window_table AS (SELECT window_id, start_date, end_date, day_count, total_return AS period_return, annual_return, sharpe, max_drawdown, turnover_mean
  FROM ({nav_summary_sql('window_book', '1', 'window_id, start_date, end_date')}))""",
    ("windows", "book"),
)


def window_table(spark, sf):
    held, moved = book(spark, sf)
    windows = po.date_windows(tables.predictions(spark, sf), LENGTH, STEP)
    return po.window_returns(po.window_values(held, moved, windows, N))


@query(
    "window_returns",
    sql(
        "window_book",
        f"SELECT window_id, start_date, end_date, day_count, {rounded(['period_return', 'annual_return', 'sharpe', 'max_drawdown', 'turnover_mean'], 5)} FROM window_table",
    ),
)
def window_returns(spark, sf):
    """Return and drawdown of the book in each window."""
    return tidy(window_table(spark, sf), 5)


_DIST = ["return_mean", "return_median", "return_std", "return_min", "return_max", "win_rate", "max_drawdown_min", "turnover_mean"]


@query(
    "window_summary",
    sql(
        "window_book",
        f"""SELECT window_count, {rounded(_DIST)}, positive_count, negative_count FROM (SELECT count(*) AS window_count, avg(r) AS return_mean, quantile_cont(r, 0.5) AS return_median,
          stddev_pop(r) AS return_std, min(r) AS return_min, max(r) AS return_max, avg((r > 0)::INT) AS win_rate, count(*) FILTER (r > 0) AS positive_count,
          count(*) FILTER (r < 0) AS negative_count, min(max_drawdown) AS max_drawdown_min, avg(turnover_mean) AS turnover_mean
          FROM (SELECT *, period_return AS r FROM window_table))""",
    ),
)
def window_summary(spark, sf):
    """Distribution of the window returns."""
    return tidy(po.window_summary(window_table(spark, sf)))


_EQUAL = """daily AS (SELECT target_trade_date, coalesce(avg(label_next_open_return), 0) AS r FROM predictions GROUP BY 1),
runs AS (SELECT target_trade_date AS end_date, product(1 + r) OVER w - 1 AS period_return FROM daily
  WINDOW w AS (ORDER BY target_trade_date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 6)"""


@query(
    "equal_weight_windows",
    sql("predictions", "SELECT end_date, round(period_return, 6) + 0 AS period_return FROM runs", _EQUAL),
)
def equal_weight_windows(spark, sf):
    """Market return of every run of six months."""
    return tidy(po.equal_weight_windows(tables.predictions(spark, sf), LENGTH))


@query(
    "equal_weight_return",
    sql("predictions", "SELECT round(product(1 + r) - 1, 6) + 0 AS period_return FROM daily", _EQUAL),
)
def equal_weight_return(spark, sf):
    """Market return over all months."""
    return tidy(po.equal_weight_return(tables.predictions(spark, sf)))


_RECENT = ["latest_window_return", "recent_return_mean", "recent_return_min", "recent_win_rate"]


@query(
    "recent_windows",
    sql(
        "predictions",
        f"""SELECT count(*) AS recent_window_count, round(arg_max(period_return, end_date), 6) + 0 AS latest_window_return, round(avg(period_return), 6) + 0 AS recent_return_mean,
          round(min(period_return), 6) + 0 AS recent_return_min, round(avg((period_return > 0)::INT), 6) + 0 AS recent_win_rate
          FROM (SELECT * FROM runs ORDER BY end_date DESC LIMIT 8)""",
        _EQUAL,
    ),
)
def recent_windows(spark, sf):
    """The last eight windows."""
    return tidy(po.recent_windows(po.equal_weight_windows(tables.predictions(spark, sf), LENGTH), 8))


@query(
    "composite_score",
    sql(
        "window_book",
        """SELECT round(0.35 * a.m + 0.25 * r.m + 0.20 * (a.m - e.m) + 0.10 * (b.total_return - p.x) + 0.01 * (a.w - e.w) + 0.10 * b.max_drawdown, 6) + 0 AS competition_score
          FROM (SELECT avg(period_return) AS m, avg((period_return > 0)::INT) AS w FROM window_table) a,
            (SELECT avg(period_return) AS m FROM (SELECT * FROM window_table ORDER BY end_date DESC LIMIT 8)) r,
            (SELECT avg(period_return) AS m, avg((period_return > 0)::INT) AS w FROM runs) e, (SELECT product(1 + r) - 1 AS x FROM daily) p,
            ("""
        + nav_summary_sql("book", "1000000")
        + ") b",
        _EQUAL,
    ),
)
def composite_score(spark, sf):
    """One number from rolling, recent, excess and drawdown."""
    df = tables.predictions(spark, sf)
    windows = window_table(spark, sf)
    rolling = po.window_summary(windows).select("return_mean", "win_rate")
    recent = po.recent_windows(windows, 8).select(F.col("recent_return_mean").alias("x")).scalar()
    market = po.return_distribution(po.equal_weight_windows(df, LENGTH))
    period = po.nav_summary(po.nav(*book(spark, sf)))
    one = lambda t, c: t.select(c).scalar()
    metrics = rolling.select(
        F.col("return_mean").alias("rolling_return_mean"),
        recent.alias("recent_return_mean"),
        (F.col("return_mean") - one(market, "return_mean")).alias("rolling_excess_mean"),
        (one(period, "total_return") - po.equal_weight_return(df).scalar()).alias("period_excess"),
        (F.col("win_rate") - one(market, "win_rate")).alias("rolling_win_excess"),
        one(period, "max_drawdown").alias("max_drawdown"),
    )
    return tidy(po.composite_score(metrics).select("competition_score"))


@query(
    "daily_orders",
    sql(
        "book",
        """SELECT target_trade_date, coalesce(b, 0) AS buy_count, coalesce(s, 0) AS sell_count, coalesce(bc, '') AS buy_stock_codes, coalesce(sc, '') AS sell_stock_codes,
          coalesce(bw, '') AS buy_weights FROM (SELECT target_trade_date, count(*) AS b, string_agg(stock_code, ',' ORDER BY stock_code) AS bc,
            string_agg(stock_code || ':' || printf('%.6f', weight), ',' ORDER BY stock_code) AS bw FROM entries GROUP BY 1)
          FULL JOIN (SELECT target_trade_date, count(*) AS s, string_agg(stock_code, ',' ORDER BY stock_code) AS sc FROM exits GROUP BY 1) USING (target_trade_date)""",
    ),
)
def daily_orders(spark, sf):
    """Orders per month as sorted lists."""
    return po.daily_orders(po.trades(book(spark, sf)[0]))


def _signals_sql(positions: str, wanted: str, n_sold: str, size: str) -> str:
    return f"""SELECT stock_code, rank, current_position, action AS suggested_action, CASE WHEN action IN ('buy', 'hold') THEN round(1.0 / ({size}), 6) + 0 ELSE 0 END::DOUBLE AS target_weight,
      CASE action WHEN 'buy' THEN '{po.ORDER_NOTES['buy']}' WHEN 'sell' THEN '{po.ORDER_NOTES['sell']}' WHEN 'hold' THEN '{po.ORDER_NOTES['hold']}' ELSE '{po.ORDER_NOTES['watch']}' END AS order_note
      FROM (SELECT *, CASE WHEN current_position AND worst <= {n_sold} THEN 'sell' WHEN current_position THEN 'hold' WHEN best <= {wanted} THEN 'buy' ELSE 'watch' END AS action FROM (
        SELECT *, CAST(row_number() OVER (ORDER BY y_score DESC NULLS LAST, stock_code) AS INTEGER) AS rank, row_number() OVER (PARTITION BY current_position ORDER BY y_score NULLS LAST, stock_code) AS worst,
          row_number() OVER (PARTITION BY current_position ORDER BY y_score DESC NULLS LAST, stock_code) AS best FROM (
          SELECT *, stock_code IN ({positions}) AS current_position FROM predictions WHERE target_trade_date = (SELECT max(target_trade_date) FROM predictions))))"""


@query("trade_signals_first", sql("predictions", _signals_sql("SELECT '' WHERE false", "20", "0", "20")))
def trade_signals_first(spark, sf):
    """Signals of the latest month without positions."""
    df = tables.predictions(spark, sf)
    out = po.trade_signals(df, None, 20, 3)
    return tidy(out.select("stock_code", "rank", "current_position", "suggested_action", "target_weight", "order_note"))


_POSITIONS = "SELECT DISTINCT stock_code FROM predictions WHERE sector = 'EUROPE' UNION SELECT 'GONE.SH'"
_HELD = f"(SELECT count(*) FROM ({_POSITIONS}))"
_LATEST = "FROM predictions WHERE target_trade_date = (SELECT max(target_trade_date) FROM predictions)"
_SOLD = f"(SELECT least(3, count(*)) {_LATEST} AND stock_code IN ({_POSITIONS}))"
_FREE = f"(SELECT count(*) {_LATEST} AND stock_code NOT IN ({_POSITIONS}))"


@query(
    "trade_signals",
    sql(
        "predictions",
        _signals_sql(_POSITIONS, f"greatest(3, 20 - ({_HELD} - {_SOLD}))", "3",
                     f"{_HELD} - {_SOLD} + least({_FREE}, greatest(3, 20 - ({_HELD} - {_SOLD})))"),
    ),
)
def trade_signals(spark, sf):
    """Signals of the latest month against positions, one of them no longer predicted."""
    df = tables.predictions(spark, sf)
    mine = df.where(F.col("sector") == "EUROPE").select("stock_code").distinct().withColumn("weight", F.lit(0.1))
    gone = spark.createDataFrame([("GONE.SH", 0.1), ("ZERO.SH", 0.0)], "stock_code string, weight double")
    out = po.trade_signals(df, mine.unionByName(gone), 20, 3)
    return tidy(out.select("stock_code", "rank", "current_position", "suggested_action", "target_weight", "order_note"))


@query(
    "buy_list",
    sql(
        "predictions",
        """SELECT stock_code, CAST(row_number() OVER (ORDER BY y_score DESC NULLS LAST, stock_code) AS INTEGER) AS rank FROM predictions
          WHERE target_trade_date = (SELECT max(target_trade_date) FROM predictions) ORDER BY rank LIMIT 20""",
    ),
)
def buy_list(spark, sf):
    """Names to buy in the latest month."""
    df = tables.predictions(spark, sf)
    return po.buy_list(po.trade_signals(df, None, 20, 3)).select("stock_code", "rank")


# -- samples and windows of the model --------------------------------------------------------


@query(
    "live_samples",
    sql(
        "samples price",
        """SELECT sample_id, stock_code, feature_asof_date, target_trade_date, label_end_date FROM samples
          WHERE target_trade_date BETWEEN DATE '2001-01-01' AND DATE '2001-12-15' AND label_end_date < DATE '2001-09-01'
            AND sample_id NOT IN (SELECT sample_id FROM live)
          UNION ALL SELECT sample_id, stock_code, feature_asof_date, target_trade_date, NULL FROM live""",
        """calendar AS (SELECT day, lead(day) OVER (ORDER BY day) AS next FROM (SELECT DISTINCT trade_date AS day FROM price UNION SELECT DATE '2001-12-15')),
        live AS (SELECT stock_code || '_' || strftime(next, '%Y-%m-%d') AS sample_id, stock_code, day AS feature_asof_date, next AS target_trade_date
          FROM price JOIN calendar ON day = trade_date WHERE day > (SELECT max(feature_asof_date) FROM samples WHERE label_end_date < DATE '2001-09-01')
            AND day < DATE '2001-12-15' AND next <= DATE '2001-12-15')""",
    ),
)
def live_samples(spark, sf):
    """Official samples up to summer and unlabelled rows from there to December."""
    official = tables.samples(spark, sf).where(F.col("label_end_date") < F.lit("2001-09-01").cast("date"))
    out = sm.live_samples(official, tables.price(spark, sf), "2001-12-15", "2001-01-01")
    return out.select("sample_id", "stock_code", "feature_asof_date", "target_trade_date", "label_end_date")


@query(
    "inference_table",
    sql(
        "samples",
        """SELECT s.sample_id, s.stock_code, round(a.spread, 6) + 0 AS spread, round(a.body, 6) + 0 AS body FROM samples s
          LEFT JOIN (SELECT sample_id, (high - low) / close AS spread, (close - open) / open AS body FROM samples) a USING (sample_id)
          WHERE target_trade_date = DATE '2000-03-01'""",
    ),
)
def inference_table(spark, sf):
    """Samples of one month with features of two blocks and without labels."""
    s = tables.samples(spark, sf)
    one = s.select("sample_id", ((F.col("high") - F.col("low")) / F.col("close")).alias("spread"))
    two = s.select("sample_id", ((F.col("close") - F.col("open")) / F.col("open")).alias("body"))
    meta = s.select("sample_id", "stock_code", "target_trade_date", "label_next_open_return")
    out = sm.inference_table(meta, [one, two], ["spread", "body"], "2000-03-01")
    return tidy(out.drop("target_trade_date"))


@query(
    "lookback_arrays",
    sql(
        "gappy samples",
        """SELECT sample_id, CAST(len(w) AS INTEGER) AS window_rows, len(w) >= 8 AS full_window,
            list_transform(list_concat(list_transform(range(8 - len(w)), lambda i: 0.0::DOUBLE), list_transform(w, lambda r: coalesce(r.x, 0))), lambda v: round(v, 4)) AS x,
            list_concat(list_transform(range(8 - len(w)), lambda i: false), list_transform(w, lambda r: r.x IS NOT NULL)) AS x_mask
          FROM (SELECT s.sample_id, list_reverse(list_reverse(list({x: g.x, d: g.trade_date} ORDER BY g.trade_date))[1:8]) AS w
            FROM samples s JOIN gappy g ON g.stock_code = s.stock_code AND g.trade_date <= s.feature_asof_date GROUP BY 1)""",
    ),
)
def lookback_arrays_query(spark, sf):
    """The last eight closes of each sample with a mask of the gaps."""
    keys = tables.samples(spark, sf).select("sample_id", "stock_code", "feature_asof_date")
    out = lookback_arrays(tables.gappy(spark, sf), keys, ["x"], 8)
    return out.select("sample_id", "window_rows", "full_window", F.transform("x", lambda v: F.round(v, 4)).alias("x"), "x_mask")


_FLOW_RATIOS = ["mf_net_amount_ratio", "mf_main_net_amount_ratio", "mf_small_order_pressure"]


@query(
    "price_flow_frame",
    sql(
        "price flow",
        f"""SELECT stock_code, trade_date, {rounded(_FLOW_RATIOS)} FROM (SELECT p.stock_code, p.trade_date, net_mf_amount * 10 / nullif(amount, 0) AS mf_net_amount_ratio,
          (buy_lg_amount + buy_elg_amount - sell_lg_amount - sell_elg_amount) * 10 / nullif(amount, 0) AS mf_main_net_amount_ratio,
          (sell_sm_amount - buy_sm_amount) * 10 / nullif(amount, 0) AS mf_small_order_pressure FROM price p
          LEFT JOIN (SELECT * FROM flow WHERE month(trade_date) <> 7) f USING (stock_code, trade_date))""",
    ),
)
def price_flow_frame_query(spark, sf):
    """Prices with money-flow ratios, missing in July."""
    flow = tables.flow(spark, sf).where(F.month("trade_date") != 7)
    return tidy(price_flow_frame(tables.price(spark, sf), flow).select("stock_code", "trade_date", *_FLOW_RATIOS))
