"""Score blending over predictions with made context."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators.keys import tradable_universe
from tidepanel.plans import blend as bl
from tidepanel.plans import predictions as pr
from tidepanel.registry import tables
from tidepanel.registry.base import query, rounded, tidy
from tidepanel.registry.q_cross_section import TARGET, avg_rank, first_rank_sql, robust_sql
from tidepanel.registry.tables import sql

LOGIT = "ln(greatest(least(direction_prob, 1 - 1e-6), 1e-6) / (1 - greatest(least(direction_prob, 1 - 1e-6), 1e-6)))"


def zsql(x: str) -> str:
    """Daily z-score in SQL, zero where undefined."""
    return f"coalesce(({x} - avg({x}) OVER ({TARGET})) / nullif(stddev_samp({x}) OVER ({TARGET}), 0), 0)"


def linear(weights: dict[str, float]) -> str:
    return " + ".join(f"({w}) * c_{n}" for n, w in weights.items())


def final(score: str) -> str:
    return f"coalesce({score}, -1e9)"


# -- heads only --------------------------------------------------------------------

_SIMPLE = {
    "y_score": "y_score",
    "final_score": "final_score",
    "return_pred": zsql("return_pred"),
    "direction_prob": zsql("direction_prob"),
    "z_y_plus_return": f"{zsql('y_score')} + {zsql('return_pred')}",
    "z_y_plus_direction": f"{zsql('y_score')} + {zsql('direction_prob')}",
    "z_all_equal": f"{zsql('y_score')} + {zsql('return_pred')} + {zsql('direction_prob')}",
}


@query(
    "score_simple_variants",
    sql(
        "predictions",
        f"SELECT sample_id, {rounded(['s_' + v for v in _SIMPLE])} FROM (SELECT sample_id, "
        + ", ".join(f"{final(e)} AS s_{v}" for v, e in _SIMPLE.items())
        + " FROM predictions)",
    ),
)
def score_simple_variants(spark, sf):
    """Single heads and sums of their z-scores."""
    df = tables.predictions(spark, sf)
    for v in _SIMPLE:
        df = bl.score_by(df, bl.ScoreParams(v), f"s_{v}")
    return tidy(df.select("sample_id", *[f"s_{v}" for v in _SIMPLE]))


def multihead_sql(source: str, out: str, extra: str = "") -> str:
    return f"""{out} AS (SELECT *, 0.62 * {zsql('final_score')} + 0.10 * {zsql('y_score')} + 0.22 * {zsql('return_pred')}
      + 0.06 * {zsql('lo')} AS multihead{extra} FROM (SELECT *, {LOGIT} AS lo FROM {source}))"""


@query(
    "score_direct_multihead",
    sql("predictions", f"SELECT sample_id, round({final('multihead')}, 6) + 0 AS score FROM mh", multihead_sql("predictions", "mh")),
)
def score_direct_multihead(spark, sf):
    """Fixed weights over all heads."""
    df = bl.score_by(tables.predictions(spark, sf), bl.ScoreParams("direct_multihead"))
    return tidy(df.select("sample_id", "score"))


_WEIGHTED = f"0.5 * {zsql('y_score')} + 0.3 * {zsql('return_pred')} + 0.2 * {zsql('direction_prob')} + 0.1 * {zsql('log_total_mv')}"


@query(
    "score_weighted_cap",
    sql(
        "predictions",
        f"""SELECT sample_id, round(CASE WHEN coalesce(cap_pct, 0) >= 0.2 THEN {final('score')} ELSE -1e9 END, 6) + 0 AS score FROM (
          SELECT *, ({avg_rank('log_total_mv', TARGET)}) / count(log_total_mv) OVER ({TARGET}) AS cap_pct,
            {_WEIGHTED} + 0.05 * {zsql('log_total_mv')} AS score FROM predictions)""",
    ),
)
def score_weighted_cap(spark, sf):
    """Chosen weights with a size term, a size bonus and a lower size limit."""
    from tidepanel.operators.cross_section import cs_pct_rank
    df = cs_pct_rank(tables.predictions(spark, sf), {"cap_pct": "log_total_mv"}, ("target_trade_date",))
    params = bl.ScoreParams("weighted", 0.5, 0.3, 0.2, 0.1, cap_min_pct=0.2, cap_bonus=0.05)
    return tidy(bl.score_by(df, params).select("sample_id", "score"))


# -- components ----------------------------------------------------------------------

_FILL = {
    "TR": "context_tr", "MF": "context_mf", "NEWS": "context_news", "HP": "context_hp", "CAP": "context_cap",
    "THEME": "context_theme_strength", "THEME_HP": "context_theme_hp", "CLUSTER": "context_cluster_strength",
    "CLUSTER_MF": "context_cluster_mf", "CLUSTER_HP": "context_cluster_hp",
}
CONTEXT_CTE = (
    robust_sql(
        "(SELECT *, " + LOGIT + " AS lo FROM context_predictions)",
        "heads",
        {"z_d": "lo", "c_F": "final_score", "c_Y": "y_score", "c_R": "return_pred", "c_CLUSTER_SIZE": "context_cluster_size"},
    )
    + """,
components AS (SELECT *, greatest(z_d, 0) + (1 - coalesce(greatest(least(context_h, 1), 0), 0) * (context_h IS NOT NULL)::INT) * least(z_d, 0) AS c_D_eff, """
    + ", ".join(f"coalesce({c}, 0) AS c_{n}" for n, c in _FILL.items())
    + ", context_oh AS c_OH, context_br AS c_BR FROM heads)"
)
_CONTEXT_NAMES = ["F", "Y", "R", "D_eff", "TR", "MF", "NEWS", "HP", "OH", "BR", "CAP", "THEME", "THEME_HP", "CLUSTER",
                  "CLUSTER_MF", "CLUSTER_HP", "CLUSTER_SIZE"]


@query(
    "score_context_components",
    sql("context_predictions", f"SELECT sample_id, {rounded(['c_' + n for n in _CONTEXT_NAMES])} FROM components", CONTEXT_CTE),
)
def score_context_components(spark, sf):
    """Heads and context as score components."""
    df = bl.context_components(tables.context_predictions(spark, sf))
    return tidy(df.select("sample_id", *[f"c_{n}" for n in _CONTEXT_NAMES]))


EXACT_CTE = (
    robust_sql(
        "(SELECT *, " + LOGIT + " AS lo FROM context_predictions)",
        "raw",
        {
            **{f"z_{n}": f"context_{n}" for n in ("roc3", "roc5", "roc20", "roc60", "rsv20", "volume_ratio")},
            "c_F": "final_score", "c_Y": "y_score", "c_R": "return_pred", "c_D_eff": "lo",
            "c_NEWS": "context_news_exact", "c_CAP": "context_log_total_mv",
        },
    )
    + """,
exact AS (SELECT *, 0.55 * z_roc20 + 0.35 * z_roc60 - 0.10 * z_rsv20 AS c_TR, 0.0::DOUBLE AS c_MF, 0.0::DOUBLE AS c_HP,
  1 / (1 + exp(-(0.8 * z_roc3 + 0.8 * z_roc5 + 0.5 * z_rsv20 + 0.3 * z_volume_ratio))) AS c_OH,
  1 / (1 + exp(-(coalesce(context_broken_ma, 0) - 0.6 * z_roc20 - 0.4 * z_roc60))) AS c_BR FROM raw)"""
)
_EXACT_NAMES = ["F", "Y", "R", "D_eff", "TR", "MF", "NEWS", "HP", "OH", "BR", "CAP"]


@query(
    "score_exact_components",
    sql(
        "context_predictions",
        f"SELECT sample_id, {rounded(['c_' + n for n in _EXACT_NAMES])}, round({linear(bl.LINEAR['exact_s5_soft'])}, 6) + 0 AS score FROM exact",
        EXACT_CTE,
    ),
)
def score_exact_components(spark, sf):
    """Components from raw price context, and the score made of them."""
    df = bl.exact_components(tables.context_predictions(spark, sf))
    df = df.withColumn("score", bl.weighted_sum(bl.LINEAR["exact_s5_soft"], "c_"))
    return tidy(df.select("sample_id", *[f"c_{n}" for n in _EXACT_NAMES], "score"))


_LINEAR = ["context_a4", "context_a4_no_news", "context_s1", "context_s2", "context_s2_no_news", "context_theme_s2"]


@query(
    "score_linear_context",
    sql(
        "context_predictions",
        f"SELECT sample_id, {rounded(_LINEAR)} FROM (SELECT sample_id, "
        + ", ".join(f"{final(linear(bl.LINEAR[v]))} AS {v}" for v in _LINEAR)
        + " FROM components)",
        CONTEXT_CTE,
    ),
)
def score_linear_context(spark, sf):
    """Six linear scores from one set of components."""
    df = bl.context_components(tables.context_predictions(spark, sf))
    return tidy(df.select("sample_id", *[bl.weighted_sum(bl.LINEAR[v], "c_").alias(v) for v in _LINEAR]))


def _register(name: str, variant: str, body: str, *ctes: str, doc: str) -> None:
    oracle = sql("context_predictions", f"SELECT sample_id, round({final('score')}, 6) + 0 AS score FROM ({body})", CONTEXT_CTE, *ctes)

    @query(name, oracle)
    def run(spark, sf):
        df = bl.score_by(tables.context_predictions(spark, sf), bl.ScoreParams(variant))
        return tidy(df.select("sample_id", "score"))

    run.__doc__ = doc


_register(
    "score_guarded",
    "context_s3",
    """SELECT sample_id, CASE WHEN c_R < -0.8 AND direction_prob < 0.48 AND context_h < 0.5 THEN least(s, floor40 - 1e-6) ELSE s END AS score
       FROM s3 JOIN (SELECT target_trade_date, min(s) AS floor40 FROM (
         SELECT *, row_number() OVER (PARTITION BY target_trade_date ORDER BY s DESC, sample_id) AS n FROM s3) WHERE n <= 40 GROUP BY 1)
       USING (target_trade_date)""",
    f"s3 AS (SELECT *, {linear(bl.LINEAR['context_s3'])} AS s FROM components)",
    doc="Linear score with doubtful rows held below the day's 40th.",
)
_register(
    "score_rerank",
    "context_s5_rerank",
    f"""SELECT sample_id, CASE WHEN c_OH > 0.80 AND c_HP < 0.3 THEN v - 0.6 ELSE v END AS score FROM (
        SELECT *, CASE WHEN n <= 80 AND NOT (c_BR > 0.75 AND NOT (c_F > 2 AND c_R > 1 AND c_MF > 0.8 AND c_NEWS > 0))
          THEN {linear(bl.LINEAR['context_s2'])} ELSE -1e9 END AS v FROM ranked)""",
    f"based AS (SELECT *, {linear(bl.RERANK_BASE)} AS base FROM components)",
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY target_trade_date ORDER BY base DESC, sample_id) AS n FROM based)",
    doc="Best 80 by one score ordered by another, broken rows out, overheated rows down.",
)
_register(
    "score_theme_rerank",
    "context_theme_s5_rerank",
    f"""SELECT sample_id, CASE WHEN c_OH > 0.85 AND c_THEME_HP < 0.2 AND c_MF < 0.2 THEN v - 0.6 ELSE v END AS score FROM (
        SELECT *, CASE WHEN (n <= 100 OR t <= 80) AND NOT (c_BR > 0.78 AND NOT ((c_F > 1.5 AND c_R > 0.6 AND c_MF > 0.5)
            OR (c_THEME > 1.4 AND c_MF > 0.2 AND c_BR < 0.70)))
          THEN {linear(bl.LINEAR['context_theme_s2'])} ELSE -1e9 END AS v FROM ranked)""",
    f"based AS (SELECT *, {linear(bl.THEME_RERANK_BASE)} AS base FROM components)",
    """ranked AS (SELECT *, row_number() OVER (PARTITION BY target_trade_date ORDER BY base DESC, sample_id) AS n,
      row_number() OVER (PARTITION BY target_trade_date ORDER BY c_THEME DESC, sample_id) AS t FROM based)""",
    doc="As the rerank, with theme leaders let in.",
)
OVERLAY_CTE = (
    multihead_sql("components", "mh").replace("AS lo FROM components", "AS lo2 FROM components").replace(zsql("lo"), zsql("lo2"))
    + f""",
overlaid AS (SELECT *, multihead + {linear({'THEME': 0.06, **bl.OVERLAY})} AS soft,
  multihead + {linear({'THEME': 0.12, **bl.OVERLAY})} AS medium, {linear(bl.CLUSTER)} AS own,
  context_cluster_id IS NOT NULL AND coalesce(context_cluster_size >= 8, false) AS valid FROM mh),
cluster_places AS (SELECT target_trade_date, context_cluster_id, row_number() OVER (PARTITION BY target_trade_date
    ORDER BY m DESC, context_cluster_id) AS place, count(*) OVER (PARTITION BY target_trade_date) AS number
  FROM (SELECT target_trade_date, context_cluster_id, avg(own) AS m FROM overlaid WHERE valid GROUP BY ALL)),
clustered AS (SELECT o.*, place, number FROM overlaid o LEFT JOIN cluster_places p
  ON o.target_trade_date = p.target_trade_date AND o.context_cluster_id = p.context_cluster_id)"""
)
_register("score_theme_soft", "direct_theme_soft", "SELECT sample_id, soft AS score FROM overlaid", OVERLAY_CTE,
          doc="Heads with a light theme overlay.")
_register("score_theme_medium", "direct_theme_medium", "SELECT sample_id, medium AS score FROM overlaid", OVERLAY_CTE,
          doc="Heads with a stronger theme overlay.")
_register(
    "score_cluster_boost",
    "direct_theme_soft_cluster_booststrong",
    """SELECT sample_id, CASE WHEN valid THEN soft + 0.22 * own + CASE WHEN place <= 8 THEN 0.04 ELSE 0 END
        - CASE WHEN place > greatest(20, ceil(number * 0.75)) THEN 0.05 ELSE 0 END ELSE soft END AS score FROM clustered""",
    OVERLAY_CTE,
    doc="Overlay with a bonus for rows of strong clusters.",
)
_register(
    "score_cluster_round_robin",
    "direct_theme_soft_cluster3",
    """SELECT sample_id, CASE WHEN chosen THEN -((within_rank - 1) * 3 + place) + 1e-4 * soft WHEN any_chosen THEN soft - 10000 ELSE soft END AS score
       FROM (SELECT *, max(chosen) OVER (PARTITION BY target_trade_date) AS any_chosen,
           row_number() OVER (PARTITION BY target_trade_date, context_cluster_id, chosen ORDER BY soft DESC, sample_id) AS within_rank
         FROM (SELECT *, valid AND coalesce(place <= 3, false) AS chosen FROM clustered))""",
    OVERLAY_CTE,
    doc="Best three clusters interleaved.",
)


# -- trend components ------------------------------------------------------------------

_TREND = {
    "trend_roc3": "context_roc3", "trend_roc5": "context_roc5", "trend_roc20": "context_roc20",
    "trend_roc60": "context_roc60", "trend_industry_excess20": "context_tr / 4", "trend_industry_excess60": "context_mf / 4",
    "trend_mf_ratio": "context_hp / 8", "trend_rsv20": "context_rsv20", "trend_volume_ratio": "context_volume_ratio",
    "trend_drawdown20": "-context_oh / 2", "trend_broken_ma": "context_broken_ma",
}
_TREND_NAMES = ["TR", "OH", "BR", "HP", "MF", "D_eff", "F", "Y", "R", "CAP"]


@query(
    "score_trend_pullback",
    sql(
        "context_predictions",
        f"SELECT sample_id, {rounded(['c_' + n for n in _TREND_NAMES])}, round({linear(bl.LINEAR['context_s2'])}, 6) + 0 AS score FROM done",
        "trended AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _TREND.items()) + f", {LOGIT} AS lo FROM context_predictions)",
        robust_sql(
            "trended", "l1",
            {
                **{f"z_{n}": f"trend_{n}" for n in ("roc3", "roc5", "roc20", "roc60", "industry_excess20", "industry_excess60",
                                                    "mf_ratio", "rsv20", "volume_ratio")},
                "z_neg3": "-trend_roc3", "z_neg5": "-trend_roc5", "z_d": "lo", "c_F": "final_score", "c_Y": "y_score",
                "c_R": "return_pred", "c_CAP": "log_total_mv",
            },
        ),
        robust_sql(
            "l1", "l2",
            {
                "c_TR": "0.55 * z_roc20 + 0.35 * z_roc60 + 0.30 * z_industry_excess20 + 0.15 * z_industry_excess60",
                "c_OH": "0.8 * z_roc3 + 0.8 * z_roc5 + 0.5 * z_rsv20 + 0.4 * z_volume_ratio - 0.3 * z_mf_ratio",
                "c_BR": "-0.7 * z_roc20 - 0.5 * z_roc60 - 0.5 * z_mf_ratio - 0.4 * z_industry_excess20 + 0.8 * coalesce(trend_broken_ma, 0) "
                "+ 0.5 * CASE WHEN trend_roc5 < -0.12 OR trend_drawdown20 < -0.18 THEN 1 ELSE 0 END",
            },
        ),
        robust_sql(
            "l2", "l3",
            {
                "c_HP": "0.55 * c_TR + 0.45 * (greatest(least(z_neg3, 1.5), 0) + greatest(least(z_neg5, 1.5), 0)) / 2 + 0.25 * z_mf_ratio "
                "- 0.25 * greatest(c_OH, 0) - 0.40 * greatest(c_BR, 0)",
            },
        ),
        "done AS (SELECT *, z_mf_ratio AS c_MF, 0 AS c_NEWS, greatest(z_d, 0) + (1 - greatest(least(c_HP, 2), 0) / 2) * least(z_d, 0) AS c_D_eff FROM l3)",
    ),
)
def score_trend_pullback(spark, sf):
    """Trend, pullback, heat and break components in three levels, and their score."""
    df = tables.context_predictions(spark, sf).withColumns({n: F.expr(e) for n, e in _TREND.items()})
    df = bl.trend_components(df)
    df = df.withColumn("score", bl.weighted_sum(bl.LINEAR["context_s2"], "c_"))
    return tidy(df.select("sample_id", *[f"c_{n}" for n in _TREND_NAMES], "score"))


# -- universe, strategy, ensemble, baseline ----------------------------------------------

_UNIVERSE = (
    "NOT contains(upper(coalesce(stock_name, '')), 'ST') AND NOT contains(coalesce(stock_name, ''), '退') "
    "AND NOT ends_with(stock_code, '.BJ') AND left(stock_code, 2) NOT IN ('43', '83', '87', '88', '89')"
)


@query(
    "tradable_universe",
    sql("predictions", f"SELECT sample_id FROM predictions WHERE {_UNIVERSE}"),
)
def tradable_universe_query(spark, sf):
    """Rows of names that may be traded."""
    return tradable_universe(tables.predictions(spark, sf), True, True).select("sample_id")


@query(
    "strategy_predictions",
    sql(
        "predictions",
        f"""SELECT sample_id, round(y_score, 6) + 0 AS y_score, round(raw_y_score, 6) + 0 AS raw_y_score, {first_rank_sql('y_score')} AS rank FROM (
          SELECT sample_id, target_trade_date, y_score AS raw_y_score, CASE WHEN coalesce(cap_pct, 0) >= 0.1 THEN {final('score')} ELSE -1e9 END AS y_score FROM (
            SELECT *, ({avg_rank('log_total_mv', TARGET)}) / count(log_total_mv) OVER ({TARGET}) AS cap_pct,
              {zsql('y_score')} + {zsql('return_pred')} AS score FROM kept))""",
        f"kept AS (SELECT * FROM predictions WHERE {_UNIVERSE})",
    ),
)
def strategy_predictions(spark, sf):
    """Tradable rows scored and ranked, small caps at the bottom."""
    params = bl.ScoreParams("z_y_plus_return", cap_min_pct=0.1, exclude_special=True, exclude_bj=True)
    df = bl.prepare_predictions(tables.predictions(spark, sf), params)
    return tidy(df.select("sample_id", "y_score", "raw_y_score", "rank"))


@query(
    "attach_market_cap",
    sql(
        "predictions metric",
        f"""SELECT sample_id, {rounded(['log_total_mv', 'cap_pct'])} FROM (
          SELECT *, ({avg_rank('log_total_mv', TARGET)}) / nullif(count(log_total_mv) OVER ({TARGET}), 0) AS cap_pct FROM (
            SELECT sample_id, target_trade_date, CASE WHEN m.total_mv IS NOT NULL THEN ln(greatest(m.total_mv, 1)) END AS log_total_mv FROM predictions p
            LEFT JOIN metric m ON m.stock_code = p.stock_code AND m.trade_date = p.feature_asof_date AND m.turnover_rate > 1))""",
    ),
)
def attach_market_cap(spark, sf):
    """Market value at the feature date, found by sample id, and its percentile."""
    preds = tables.predictions(spark, sf).drop("log_total_mv", "feature_asof_date")
    metric = tables.metric(spark, sf).where(F.col("turnover_rate") > 1)
    df = bl.attach_market_cap(preds, metric, tables.samples(spark, sf))
    return tidy(df.select("sample_id", "log_total_mv", "cap_pct"))


_MODELS = {
    "a": ("y_score", "final_score", "return_pred", "direction_prob", "g_price", "target_trade_date >= DATE '1996-06-01'"),
    "b": ("final_score", "y_score", "return_pred * 2 + g_text", "g_fundamental", "g_text", "target_trade_date < DATE '2001-01-01'"),
}


def _ensemble_sql() -> str:
    parts = []
    for n, (y, f, r, d, g, keep) in _MODELS.items():
        parts.append(f"""{n}0 AS (SELECT sample_id, target_trade_date, {y} AS y_score, {f} AS final_score, {r} AS return_pred, {d} AS direction_prob,
  {g} AS g_price FROM predictions WHERE {keep})""")
    for n in _MODELS:
        parts.append(f"""{n} AS (SELECT sample_id, target_trade_date, {zsql('y_score')} AS y_score, {zsql('final_score')} AS final_score,
  {zsql('return_pred')} AS return_pred, greatest(least(direction_prob, 1 - 1e-6), 1e-6) AS direction_prob, g_price
  FROM {n}0 WHERE sample_id IN (SELECT sample_id FROM a0 INTERSECT SELECT sample_id FROM b0))""")
    return ",\n".join(parts)


@query(
    "ensemble_predictions",
    sql(
        "predictions",
        f"""SELECT sample_id, {rounded(['y_score', 'final_score', 'return_pred', 'direction_prob', 'g_price'])}, rank FROM (
          SELECT *, {first_rank_sql('final_score')} AS rank FROM (
            SELECT a.sample_id, a.target_trade_date, (a.y_score + b.y_score) / 2 AS y_score, (a.final_score + b.final_score) / 2 AS final_score,
              (a.return_pred + b.return_pred) / 2 AS return_pred, (a.direction_prob + b.direction_prob) / 2 AS direction_prob,
              (a.g_price + b.g_price) / 2 AS g_price FROM a JOIN b USING (sample_id)))""",
        _ensemble_sql(),
    ),
)
def ensemble_predictions(spark, sf):
    """Two models averaged over the samples both have."""
    preds = tables.predictions(spark, sf)
    parts = []
    for y, f, r, d, g, keep in _MODELS.values():
        parts.append(
            preds.where(F.expr(keep)).select(
                "sample_id", "target_trade_date", F.expr(y).alias("y_score"), F.expr(f).alias("final_score"),
                F.expr(r).alias("return_pred"), F.expr(d).alias("direction_prob"), F.expr(g).alias("g_price"),
            )
        )
    out = pr.ensemble(parts)
    return tidy(out.select("sample_id", "y_score", "final_score", "return_pred", "direction_prob", "g_price", "rank"))


@query(
    "single_factor_baseline",
    sql(
        "predictions",
        f"""SELECT sample_id, {rounded(['y_score', 'direction_prob', 'g_price'])}, {first_rank_sql('y_score')} AS rank FROM (
          SELECT sample_id, target_trade_date, return_pred AS y_score, 1 / (1 + exp(-coalesce(return_pred, 0))) AS direction_prob,
            1.0::DOUBLE AS g_price FROM predictions)""",
    ),
)
def single_factor_baseline(spark, sf):
    """One factor taken as the prediction."""
    df = pr.single_factor_predictions(tables.predictions(spark, sf), "return_pred")
    return tidy(df.select("sample_id", "y_score", "direction_prob", "g_price", "rank"))
