"""Context of samples from price, metric, flow and news-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.plans import context as cx
from tidepanel.registry import tables
from tidepanel.registry.base import query, rounded, tidy
from tidepanel.registry.q_cross_section import bin_sql, robust_sql
from tidepanel.registry.q_timeseries import ENTITY, gate, rolling
from tidepanel.registry.tables import _noise, _noise_sql, define, sql
from tidepanel.scale import freeze

ROCS = (3, 5, 20, 60)


def _ratio(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


_MA20, _MA60 = gate("close", 20, f"avg(close) OVER {rolling(20)}", 10), gate("close", 60, f"avg(close) OVER {rolling(60)}", 30)
_HIGH, _LOW = gate("high", 20, f"max(high) OVER {rolling(20)}", 10), gate("low", 20, f"min(low) OVER {rolling(20)}", 10)
_VOL = gate("volume", 20, f"avg(volume) OVER {rolling(20)}", 10)



def ranges_sql(name: str, source: str) -> str:
    """CTE with moving averages, ranges and returns of bars."""
    rocs = ", ".join(f"close / nullif(lag(close, {w}) OVER ({ENTITY}), 0) - 1 AS roc{w}" for w in ROCS)
    return (
        f"{name} AS (SELECT *, {rocs}, close / nullif(lag(close) OVER ({ENTITY}), 0) - 1 AS ret, {_MA20} AS ma20, "
        f"{_MA60} AS ma60, {_HIGH} AS high20, {_LOW} AS low20, {_VOL} AS vol20 FROM {source})"
    )


define(
    "price_context",
    f"""{ranges_sql('ranges', "(SELECT * REPLACE (coalesce(industry, '') AS industry) FROM price)")},
price_context AS (SELECT stock_code, trade_date, {', '.join(f'roc{w} AS context_roc{w}' for w in ROCS)},
  {_ratio('close - low20', 'high20 - low20')} AS context_rsv20,
  CASE WHEN close < ma20 AND close < ma60 THEN 1.0 ELSE 0.0 END::DOUBLE AS context_broken_ma,
  roc20 - avg(roc20) OVER i AS context_industry_relative20, roc60 - avg(roc60) OVER i AS context_industry_relative60,
  0.5 * (roc20 - avg(roc20) OVER i) + 0.5 * (roc60 - avg(roc60) OVER i) AS context_industry_relative
  FROM ranges WINDOW i AS (PARTITION BY industry, trade_date))""",
    ("price",),
)
PRICE_COLUMNS = [*[f"context_roc{w}" for w in ROCS], "context_rsv20", "context_broken_ma", "context_industry_relative20",
                 "context_industry_relative60", "context_industry_relative"]


@query("context_price", sql("price_context", f"SELECT stock_code, trade_date, {rounded(PRICE_COLUMNS)} FROM price_context"))
def context_price(spark, sf):
    """Returns, range place, broken trend and industry-relative returns."""
    return tidy(cx.price_context(tables.price(spark, sf)))


define(
    "flow_confirm",
    """flow_confirm AS (SELECT stock_code, trade_date, (b - s + n) / (abs(b) + abs(s) + abs(n) + 1) AS context_moneyflow_confirm FROM (
  SELECT *, buy_lg_amount + buy_elg_amount AS b, sell_lg_amount + sell_elg_amount AS s, coalesce(net_mf_amount, 0) AS n FROM flow))""",
    ("flow",),
)


@query(
    "context_flow",
    sql("flow_confirm", "SELECT stock_code, trade_date, round(context_moneyflow_confirm, 6) + 0 AS context_moneyflow_confirm FROM flow_confirm"),
)
def context_flow(spark, sf):
    """Large net buying against large turnover."""
    return tidy(cx.flow_confirm(tables.flow(spark, sf)))


def regime_features(samples: DataFrame) -> DataFrame:
    names = {n: _noise(601 + 6 * i, 307 + 4 * i) for i, n in enumerate(cx.REGIME_FEATURES)}
    return samples.select("sample_id", *[v.alias(n) for n, v in names.items()])


_REGIME = " + ".join(_noise_sql(601 + 6 * i, 307 + 4 * i) for i in range(len(cx.REGIME_FEATURES)))


@query(
    "context_regime",
    sql("samples", f"SELECT sample_id, round({_REGIME}, 6) + 0 AS context_regime_momentum FROM samples"),
)
def context_regime(spark, sf):
    """Sum of three registered features."""
    return tidy(cx.regime_momentum(regime_features(tables.samples(spark, sf))))


def news_scores(samples: DataFrame) -> DataFrame:
    k, m = F.col("k"), F.col("mno")
    return samples.select(
        "sample_id",
        F.when((k + m) % 3 == 0, _noise(811, 401) - 0.5).alias("context_news_exact3"),
        F.when((k + m) % 3 != 1, _noise(821, 409) - 0.5).alias("context_news_exact5"),
    )


def raw_context(spark, sf) -> DataFrame:
    """Samples with raw context; the sector stands for the industry of the theme buckets.

    The price table is read by five branches, so it is a stage table here.
    """
    price = freeze(tables.price(spark, sf), "price")
    samples = tables.samples(spark, sf, price).select(
        "sample_id", "stock_code", "industry", "sector", "feature_asof_date", "target_trade_date", "k", "mno"
    )
    return cx.attach_raw_context(
        samples, price, tables.metric(spark, sf, price), tables.flow(spark, sf),
        cx.regime_momentum(regime_features(samples)), news_scores(samples),
    )


define(
    "raw_context",
    f"""raw_context AS (SELECT s.sample_id, s.stock_code, s.industry, s.sector, s.feature_asof_date, s.target_trade_date,
  {', '.join('p.' + c for c in PRICE_COLUMNS)}, m.volume_ratio AS context_volume_ratio, ln(greatest(m.circ_mv, 1)) AS context_log_total_mv,
  f.context_moneyflow_confirm, {_REGIME} AS context_regime_momentum,
  CASE WHEN (k + mno) % 3 = 0 THEN {_noise_sql(811, 401)} - 0.5 END AS context_news_exact3,
  CASE WHEN (k + mno) % 3 <> 1 THEN {_noise_sql(821, 409)} - 0.5 END AS context_news_exact5
  FROM samples s LEFT JOIN price_context p ON p.stock_code = s.stock_code AND p.trade_date = s.feature_asof_date
  LEFT JOIN metric m ON m.stock_code = s.stock_code AND m.trade_date = s.feature_asof_date
  LEFT JOIN flow_confirm f ON f.stock_code = s.stock_code AND f.trade_date = s.feature_asof_date)""",
    ("samples", "price_context", "metric", "flow_confirm"),
)
RAW_COLUMNS = [*PRICE_COLUMNS, "context_volume_ratio", "context_log_total_mv", "context_moneyflow_confirm",
               "context_regime_momentum", "context_news_exact3", "context_news_exact5"]


@query("context_raw", sql("raw_context", f"SELECT sample_id, {rounded(RAW_COLUMNS)} FROM raw_context"))
def context_raw(spark, sf):
    """Raw context of samples at their feature date."""
    return tidy(raw_context(spark, sf).select("sample_id", *RAW_COLUMNS))


_T = "PARTITION BY target_trade_date"
_SIG = "1 / (1 + exp(-greatest(least({0}, 30), -30)))"


def _sigmoid(x: str) -> str:
    return _SIG.format(f"({x})")


define(
    "theme",
    robust_sql("raw_context", "pulled", {"neg3": "-context_roc3", "neg5": "-context_roc5"})
    + f""",
moderate AS (SELECT * EXCLUDE (neg3, neg5), greatest(least(neg3, 1.5), 0) * greatest(least(neg5, 1.5), 0)
    * CASE WHEN context_roc5 >= quantile_cont(context_roc5, 0.05) OVER ({_T}) THEN 1 ELSE 0 END AS context_moderate_pullback FROM pulled),
binned AS (SELECT *, {bin_sql('context_roc20', 5)} AS b20, {bin_sql('context_roc60', 5)} AS b60,
    context_roc20 IS NOT NULL AND context_roc60 IS NOT NULL AS valid FROM moderate),
bucketed AS (SELECT *, count(*) OVER small AS n_small, count(*) OVER big AS n_big,
    {', '.join(f"avg({e}) OVER small AS {n}_small, avg({e}) OVER big AS {n}_big" for n, e in (('ret20', 'context_roc20'), ('ret60', 'context_roc60'), ('pos20', 'CASE WHEN context_roc20 > 0 THEN 1.0 ELSE 0.0 END'), ('mf', 'context_moneyflow_confirm')))}
  FROM binned WINDOW small AS (PARTITION BY target_trade_date, sector, b20, b60, valid), big AS (PARTITION BY target_trade_date, b20, b60, valid)),
peers AS (SELECT * EXCLUDE (b20, b60), CASE WHEN valid THEN CASE WHEN n_small >= 2 THEN n_small ELSE n_big END END::DOUBLE AS context_theme_peer_count,
    {', '.join(f"CASE WHEN valid THEN CASE WHEN n_small >= 2 THEN {n}_small ELSE {n}_big END END AS context_theme_peer_{n}" for n in ('ret20', 'ret60', 'pos20', 'mf'))}
  FROM bucketed),
"""
    + robust_sql(
        "peers", "peer_z",
        {"z20": "context_theme_peer_ret20", "z60": "context_theme_peer_ret60", "zp": "context_theme_peer_pos20",
         "zm": "context_theme_peer_mf", "zr20": "context_industry_relative20", "zr60": "context_industry_relative60"},
    )
    + ",\n"
    + robust_sql(
        "peer_z", "strong",
        {"context_theme_strength": "0.35 * z20 + 0.30 * z60 + 0.15 * zp + 0.10 * zm + 0.05 * zr20 + 0.05 * zr60"},
    )
    + f""",
theme AS (SELECT * EXCLUDE (z20, z60, zp, zm, zr20, zr60), context_roc20 - context_theme_peer_ret20 AS context_theme_escape20,
    context_roc60 - context_theme_peer_ret60 AS context_theme_escape60,
    {_sigmoid('context_theme_strength')} * context_moderate_pullback * {_sigmoid('zm')} AS context_theme_h FROM strong)""",
    ("raw_context",),
)
THEME_COLUMNS = [c for c in cx.CONTEXT_COLUMNS if c.startswith("context_theme") and c != "context_theme_hp"]


def themed(spark, sf) -> DataFrame:
    return cx.theme_context(cx._pullback_inputs(raw_context(spark, sf)), 2, "sector")


@query(
    "context_theme",
    sql("theme", f"SELECT sample_id, {rounded(['context_moderate_pullback', *THEME_COLUMNS])} FROM theme"),
)
def context_theme(spark, sf):
    """Momentum peers with fallback to the market, theme strength and health."""
    return tidy(themed(spark, sf).select("sample_id", "context_moderate_pullback", *THEME_COLUMNS))


define(
    "state",
    robust_sql(
        "(SELECT *, 0.5 * context_news_exact3 + 0.5 * context_news_exact5 AS context_news_exact FROM theme)", "state_z",
        {
            "context_tr": "0.6 * context_roc20 + 0.4 * context_roc60 + 0.4 * context_industry_relative + 0.4 * context_regime_momentum",
            "context_mf": "context_moneyflow_confirm", "context_industry": "context_industry_relative",
            "context_regime": "context_regime_momentum", "context_news": "context_news_exact", "context_cap": "context_log_total_mv",
            "r3": "context_roc3", "r5": "context_roc5", "r20": "context_roc20", "r60": "context_roc60", "rr": "context_rsv20",
            "rv": "context_volume_ratio", "context_theme_hp": "context_theme_h",
        },
    )
    + f""",
heated AS (SELECT *, {_sigmoid('0.8 * r3 + 0.8 * r5 + 0.5 * rr + 0.4 * rv - 0.3 * context_mf')} AS context_oh,
  {_sigmoid('-0.7 * r20 - 0.5 * r60 - 0.5 * context_mf - 0.4 * context_industry + coalesce(context_broken_ma, 0)')} AS context_br,
  {_sigmoid('0.6 * r20 + 0.4 * r60 + 0.4 * context_industry + 0.4 * context_regime')} AS tide FROM state_z),
healthy AS (SELECT *, tide * context_moderate_pullback * {_sigmoid('context_mf')} * {_sigmoid('context_industry')}
  * (1 - context_oh) * (1 - context_br) AS context_h FROM heated),
"""
    + robust_sql("healthy", "state", {"context_hp": "context_h"}),
    ("theme",),
)
STATE_COLUMNS = ["context_news_exact", "context_tr", "context_mf", "context_industry", "context_regime", "context_news",
                 "context_cap", "context_oh", "context_br", "context_h", "context_hp", "context_theme_hp"]


@query("context_state", sql("state", f"SELECT sample_id, {rounded(STATE_COLUMNS)} FROM state"))
def context_state(spark, sf):
    """Trend, flow, industry, regime, news, size, overheat, break and health."""
    return tidy(cx.state_context(themed(spark, sf)).select("sample_id", *STATE_COLUMNS))


define(
    "clustered_context",
    f"""styled AS (SELECT *, context_theme_strength AS c_theme, 0.45 * context_tr + 0.25 * context_industry + 0.20 * context_regime
    + 0.10 * context_theme_strength AS c_trend, 0.45 * context_oh + 0.55 * context_br - 0.25 * context_hp AS c_risk FROM state),
style_bins AS (SELECT *, ({bin_sql('c_theme', 4)} * 36 + {bin_sql('c_trend', 4)} * 9 + {bin_sql('context_mf', 3)} * 3
    + {bin_sql('c_risk', 3)})::DOUBLE AS context_cluster_id FROM styled),
style_stats AS (SELECT *, count(*) OVER c::DOUBLE AS context_cluster_size, avg(c_theme + c_trend) OVER c AS cs, avg(context_mf) OVER c AS cm,
    avg(context_hp) OVER c AS ch FROM style_bins WINDOW c AS (PARTITION BY target_trade_date, context_cluster_id)),
""".replace("count(*) OVER c::DOUBLE", "(count(*) OVER c)::DOUBLE")
    + robust_sql("style_stats", "clustered_context", {"context_cluster_strength": "cs", "context_cluster_mf": "cm", "context_cluster_hp": "ch"}),
    ("state",),
)
CLUSTER_COLUMNS = [c for c in cx.CONTEXT_COLUMNS if c.startswith("context_cluster")]


@query(
    "context_cluster",
    sql("clustered_context", f"SELECT sample_id, {rounded(CLUSTER_COLUMNS, 5)} FROM clustered_context"),
)
def context_cluster(spark, sf):
    """Style clusters and their means."""
    df = cx.cluster_context(cx.state_context(themed(spark, sf)))
    return tidy(df.select("sample_id", *CLUSTER_COLUMNS), 5)


@query(
    "context_table",
    sql("clustered_context", f"SELECT sample_id, {rounded(cx.CONTEXT_COLUMNS, 5)} FROM clustered_context"),
)
def context_table(spark, sf):
    """All 42 context columns of every sample in one job."""
    df = cx.derive_context(raw_context(spark, sf), 2, "sector")
    return tidy(cx.context_table(df), 5)


_NEEDED = [c for c in cx.CONTEXT_COLUMNS if c not in cx.MAY_BE_EMPTY and c in RAW_COLUMNS]


@query(
    "context_coverage",
    sql("raw_context", "SELECT " + ", ".join(f"count({c}) AS {c}" for c in _NEEDED) + " FROM raw_context"),
)
def context_coverage(spark, sf):
    """Number of present values per raw context column."""
    return raw_context(spark, sf).agg(*[F.count(c).alias(c) for c in _NEEDED])


TREND_COLUMNS = ["trend_roc3", "trend_roc5", "trend_roc20", "trend_roc60", "trend_drawdown20", "trend_rsv20",
                 "trend_volume_ratio", "trend_broken_ma", "trend_industry_excess20", "trend_industry_excess60",
                 "trend_market_roc20", "trend_market_roc60", "trend_mf_ratio"]


@query(
    "trend_features",
    sql(
        "predictions flow",
        f"SELECT p.sample_id, {rounded(TREND_COLUMNS, 5)} FROM predictions p LEFT JOIN stock_trend s ON s.stock_code = p.stock_code "
        "AND s.trade_date = p.feature_asof_date LEFT JOIN industry_trend i ON i.industry = p.industry AND i.trade_date = p.feature_asof_date "
        "LEFT JOIN market_trend m ON m.trade_date = p.feature_asof_date",
        ranges_sql("ranges", "(SELECT * REPLACE (coalesce(industry, '') AS industry, " + ", ".join(
            f"1000 + {c} / 100 AS {c}" for c in ("close", "high", "low")) + ") FROM price)"),
        f"""stock_trend AS (SELECT r.stock_code, r.trade_date, {', '.join(f'roc{w} AS trend_roc{w}' for w in ROCS)},
          {_ratio('close', 'high20')} - 1 AS trend_drawdown20, {_ratio('close - low20', 'high20 - low20')} AS trend_rsv20,
          {_ratio('volume', 'vol20')} - 1 AS trend_volume_ratio, CASE WHEN close < ma20 AND close < ma60 THEN 1.0 ELSE 0.0 END::DOUBLE AS trend_broken_ma,
          f.net_mf_amount / nullif(r.amount, 0) AS trend_mf_ratio
          FROM ranges r LEFT JOIN flow f ON f.stock_code = r.stock_code AND f.trade_date = r.trade_date)""",
        """market_level AS (SELECT trade_date, product(1 + coalesce(r, 0)) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS level
          FROM (SELECT trade_date, avg(ret) AS r FROM ranges GROUP BY 1)),
        market_trend AS (SELECT trade_date, level / nullif(lag(level, 20) OVER (ORDER BY trade_date), 0) - 1 AS trend_market_roc20,
          level / nullif(lag(level, 60) OVER (ORDER BY trade_date), 0) - 1 AS trend_market_roc60 FROM market_level),
        industry_level AS (SELECT industry, trade_date, product(1 + coalesce(r, 0)) OVER (PARTITION BY industry ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS level
          FROM (SELECT industry, trade_date, avg(ret) AS r FROM ranges GROUP BY ALL)),
        industry_roc AS (SELECT industry, trade_date, level / nullif(lag(level, 20) OVER (PARTITION BY industry ORDER BY trade_date), 0) - 1 AS r20,
          level / nullif(lag(level, 60) OVER (PARTITION BY industry ORDER BY trade_date), 0) - 1 AS r60 FROM industry_level),
        industry_trend AS (SELECT industry, trade_date, r20 - trend_market_roc20 AS trend_industry_excess20,
          r60 - trend_market_roc60 AS trend_industry_excess60 FROM industry_roc LEFT JOIN market_trend USING (trade_date))""",
    ),
)
def trend_features(spark, sf):
    """Entity, industry and market trend of predictions, from damped prices."""
    calm = tables.price(spark, sf).withColumns({c: F.col(c) / 100 + 1000 for c in ("close", "high", "low")})
    df = cx.attach_trend(tables.predictions(spark, sf), calm, tables.flow(spark, sf))
    return tidy(df.select("sample_id", *TREND_COLUMNS), 5)
