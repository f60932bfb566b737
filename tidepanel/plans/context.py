"""Context of samples: price, flow, regime, theme, health and style clusters, visible as of the feature date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalar import clip, finite, flag, number, safe_div, sigmoid
from tidepanel.operators.cross_section import TARGET, group_values, quantile_bin, robust_z
from tidepanel.operators.joins import bucket_means_with_fallback
from tidepanel.operators.keys import require_columns
from tidepanel.operators.timeseries import (
    compounded,
    history,
    repair_prices,
    returns,
    ts_max,
    ts_mean,
    ts_min,
)

# Registered features whose sum is the regime momentum, and all columns made here.
REGIME_FEATURES = ("gpt_rg_mom20_turnover_delta5", "gpt_rg_mom10_amount_delta5", "gpt_rg_indmom20_amount_delta10")
CONTEXT_COLUMNS = (
    "context_roc3", "context_roc5", "context_roc20", "context_roc60", "context_rsv20", "context_volume_ratio",
    "context_industry_relative20", "context_industry_relative60", "context_industry_relative",
    "context_regime_momentum", "context_moneyflow_confirm", "context_news_exact3", "context_news_exact5",
    "context_news_exact", "context_log_total_mv", "context_broken_ma", "context_moderate_pullback", "context_tr",
    "context_mf", "context_industry", "context_regime", "context_news", "context_cap", "context_oh", "context_br",
    "context_h", "context_hp", "context_theme_peer_count", "context_theme_peer_ret20", "context_theme_peer_ret60",
    "context_theme_peer_pos20", "context_theme_peer_mf", "context_theme_escape20", "context_theme_escape60",
    "context_theme_strength", "context_theme_h", "context_theme_hp", "context_cluster_id", "context_cluster_size",
    "context_cluster_strength", "context_cluster_mf", "context_cluster_hp",
)
MAY_BE_EMPTY = ("context_news_exact3", "context_news_exact5", "context_news_exact", "context_news")
SQUASH = 30.0
THEME_MIN_PEERS = 5


def _ranges(close: str = "close") -> dict[str, Column]:
    return {
        "_ma20": ts_mean(close, 20, 10),
        "_ma60": ts_mean(close, 60, 30),
        "_high20": ts_max("high", 20, 10),
        "_low20": ts_min("low", 20, 10),
    }


def price_context(price: DataFrame, repair: bool = True) -> DataFrame:
    """Returns, range position, broken trend and industry-relative returns per entity and day."""
    work = price.withColumn("industry", F.coalesce(F.col("industry"), F.lit("")))
    if repair and {"preclose", "change", "pct_chg"} <= set(work.columns):
        work = repair_prices(work)
    rocs = {f"context_roc{w}": returns("close", w) for w in (3, 5, 20, 60)}
    work = work.withColumns({**rocs, **_ranges()})
    close = F.col("close")
    below = flag((close < F.col("_ma20")) & (close < F.col("_ma60")))
    work = work.withColumns(
        {
            "context_rsv20": safe_div(close - F.col("_low20"), F.col("_high20") - F.col("_low20")),
            "context_broken_ma": below,
        }
    )
    means = {"_i20": F.avg("context_roc20"), "_i60": F.avg("context_roc60")}
    work = group_values(work, ["industry", "trade_date"], means)
    work = work.withColumns(
        {
            "context_industry_relative20": F.col("context_roc20") - F.col("_i20"),
            "context_industry_relative60": F.col("context_roc60") - F.col("_i60"),
        }
    )
    both = F.col("context_industry_relative20") * 0.5 + F.col("context_industry_relative60") * 0.5
    return work.select(
        "stock_code", "trade_date", *rocs, "context_rsv20", "context_broken_ma",
        "context_industry_relative20", "context_industry_relative60", both.alias("context_industry_relative"),
    )


def flow_confirm(flow: DataFrame) -> DataFrame:
    """Large net buying relative to large turnover, between -1 and 1."""
    n = lambda c: F.coalesce(number(c), F.lit(0.0)) if c in flow.columns else F.lit(0.0)
    bought, sold = n("buy_lg_amount") + n("buy_elg_amount"), n("sell_lg_amount") + n("sell_elg_amount")
    net = n("net_mf_amount")
    return flow.select(
        "stock_code", "trade_date",
        ((bought - sold + net) / (F.abs(bought) + F.abs(sold) + F.abs(net) + 1.0)).alias("context_moneyflow_confirm"),
    )


def regime_momentum(features: DataFrame, names: Sequence[str] = REGIME_FEATURES) -> DataFrame:
    total = number(names[0])
    for name in names[1:]:
        total = total + number(name)
    return features.select("sample_id", total.alias("context_regime_momentum"))


def metric_context(metric: DataFrame) -> DataFrame:
    """Volume ratio and log of the circulating value."""
    return metric.select(
        "stock_code", "trade_date",
        number("volume_ratio").alias("context_volume_ratio"),
        F.ln(clip(number("circ_mv"), lower=1.0)).alias("context_log_total_mv"),
    )


def attach_raw_context(
    samples: DataFrame,
    price: DataFrame,
    metric: DataFrame,
    flow: DataFrame,
    regime: DataFrame,
    news: DataFrame
) -> DataFrame:
    """Samples with all raw context at their feature date."""
    require_columns(samples, ("sample_id", "stock_code", "industry", "feature_asof_date", "target_trade_date"), "samples")
    work = samples
    for side in (price_context(price), metric_context(metric), flow_confirm(flow)):
        work = work.join(
            side.withColumnRenamed("trade_date", "feature_asof_date"), ["stock_code", "feature_asof_date"], "left"
        )
    return work.join(regime, "sample_id", "left").join(news, "sample_id", "left")


RELATIVE = {"_r20": "context_industry_relative20", "_r60": "context_industry_relative60"}


def _pullback_inputs(df: DataFrame) -> DataFrame:
    """Add bounded recent losses and whether the 5-row return is above the day's worst 5%."""
    losses = {"_neg3": -F.col("context_roc3"), "_neg5": -F.col("context_roc5")}
    if "_floor" in df.columns:  # scored with all other raw columns
        work = df
    else:
        work = robust_z(df, losses, TARGET, quantiles={"_floor": ("context_roc5", 0.05)})
    above = flag(F.col("context_roc5") >= F.col("_floor"))
    moderate = clip("_neg3", 0.0, 1.5) * clip("_neg5", 0.0, 1.5) * above
    return work.withColumn("context_moderate_pullback", moderate).drop("_neg3", "_neg5", "_floor")


def theme_context(
    df: DataFrame,
    min_peers: int = THEME_MIN_PEERS,
    industry: str = "industry"
) -> DataFrame:
    """Peers in the same industry and momentum bucket, or in the market's bucket where the industry's is thin.

    Needs ``context_moderate_pullback``; the five by five buckets are quintiles of
    the 20- and 60-row returns of the day.
    """
    work = quantile_bin(df, {"_b20": ("context_roc20", 5), "_b60": ("context_roc60", 5)}, TARGET)
    valid = F.col("context_roc20").isNotNull() & F.col("context_roc60").isNotNull()
    only = lambda x: F.when(valid, x)
    work = work.withColumns(
        {
            "_ind": F.coalesce(F.col(industry).cast("string"), F.lit("")),
            "_b20": only(F.col("_b20")),
            "_b60": only(F.col("_b60")),
        }
    )
    market = ["target_trade_date", "_b20", "_b60"]
    peers = bucket_means_with_fallback(
        work,
        ["target_trade_date", "_ind", "_b20", "_b60"],
        market,
        {
            "context_theme_peer_ret20": F.col("context_roc20"),
            "context_theme_peer_ret60": F.col("context_roc60"),
            "context_theme_peer_pos20": (F.col("context_roc20") > 0).cast("double"),
            "context_theme_peer_mf": finite("context_moneyflow_confirm"),
        },
        "context_theme_peer_count",
        min_peers,
    )
    names = [f"context_theme_peer_{n}" for n in ("count", "ret20", "ret60", "pos20", "mf")]
    work = peers.withColumns({n: only(F.col(n)).cast("double") for n in names})
    work = work.withColumns(
        {
            "context_theme_escape20": F.col("context_roc20") - F.col("context_theme_peer_ret20"),
            "context_theme_escape60": F.col("context_roc60") - F.col("context_theme_peer_ret60"),
        }
    )
    z = {
        "_z20": F.col("context_theme_peer_ret20"),
        "_z60": F.col("context_theme_peer_ret60"),
        "_zp": F.col("context_theme_peer_pos20"),
        "_zm": F.col("context_theme_peer_mf"),
        **{n: x for n, x in RELATIVE.items() if n not in work.columns},
    }
    work = robust_z(work, z, TARGET)
    c = F.col
    strength = c("_z20") * 0.35 + c("_z60") * 0.30 + c("_zp") * 0.15 + c("_zm") * 0.10 + c("_r20") * 0.05 + c("_r60") * 0.05
    work = robust_z(work, {"context_theme_strength": strength}, TARGET)
    health = (
        sigmoid("context_theme_strength", SQUASH)
        * F.coalesce(c("context_moderate_pullback"), F.lit(0.0))
        * sigmoid("_zm", SQUASH)
    )
    return work.withColumn("context_theme_h", health).drop(*z, *RELATIVE, "_b20", "_b60", "_ind")


def _state_inputs() -> dict[str, Column]:
    """What the state is scored from, all of it raw."""
    c = F.col
    trend = (
        c("context_roc20") * 0.6 + c("context_roc60") * 0.4 + c("context_industry_relative") * 0.4
        + c("context_regime_momentum") * 0.4
    )
    return {
        "context_tr": trend,
        "context_mf": c("context_moneyflow_confirm"),
        "context_industry": c("context_industry_relative"),
        "context_regime": c("context_regime_momentum"),
        "context_news": c("context_news_exact3") * 0.5 + c("context_news_exact5") * 0.5,
        "context_cap": c("context_log_total_mv"),
        "_s3": c("context_roc3"),
        "_s5": c("context_roc5"),
        "_s20": c("context_roc20"),
        "_s60": c("context_roc60"),
        "_sr": c("context_rsv20"),
        "_sv": c("context_volume_ratio"),
    }


def raw_scores(df: DataFrame) -> DataFrame:
    """Add the daily scores of everything raw that later steps need, with one pair of aggregates per day."""
    losses = {"_neg3": -F.col("context_roc3"), "_neg5": -F.col("context_roc5")}
    return robust_z(df, {**losses, **RELATIVE, **_state_inputs()}, TARGET, quantiles={"_floor": ("context_roc5", 0.05)})


def state_context(df: DataFrame) -> DataFrame:
    """Trend, flow, industry, regime, news and size as z-scores, overheat and break, and health."""
    c = F.col
    work = df.withColumn("context_news_exact", c("context_news_exact3") * 0.5 + c("context_news_exact5") * 0.5)
    first = {n: x for n, x in _state_inputs().items() if n not in work.columns}
    scored_before = not first
    if first:
        work = robust_z(work, {**first, "context_theme_hp": c("context_theme_h")}, TARGET)
    heat = c("_s3") * 0.8 + c("_s5") * 0.8 + c("_sr") * 0.5 + c("_sv") * 0.4 - c("context_mf") * 0.3
    broken = (
        c("_s20") * -0.7 - c("_s60") * 0.5 - c("context_mf") * 0.5 - c("context_industry") * 0.4
        + F.coalesce(c("context_broken_ma"), F.lit(0.0))
    )
    work = work.withColumns({"context_oh": sigmoid(heat, SQUASH), "context_br": sigmoid(broken, SQUASH)})
    tide = c("_s20") * 0.6 + c("_s60") * 0.4 + c("context_industry") * 0.4 + c("context_regime") * 0.4
    health = (
        sigmoid(tide, SQUASH)
        * F.coalesce(c("context_moderate_pullback"), F.lit(0.0))
        * sigmoid("context_mf", SQUASH)
        * sigmoid("context_industry", SQUASH)
        * (1.0 - c("context_oh"))
        * (1.0 - c("context_br"))
    )
    work = work.withColumn("context_h", health)
    late = {"context_hp": c("context_h")}
    if scored_before:
        late["context_theme_hp"] = c("context_theme_h")
    return robust_z(work, late, TARGET).drop("_s3", "_s5", "_s20", "_s60", "_sr", "_sv")


def cluster_context(df: DataFrame) -> DataFrame:
    """Style cluster of each row from daily quantile bins, with the cluster's size and mean strength, flow, health."""
    c = F.col
    theme = c("context_theme_strength")
    trend = c("context_tr") * 0.45 + c("context_industry") * 0.25 + c("context_regime") * 0.20 + theme * 0.10
    risk = c("context_oh") * 0.45 + c("context_br") * 0.55 - c("context_hp") * 0.25
    work = df.withColumns({"_theme": theme, "_trend": trend, "_flow": c("context_mf"), "_risk": risk})
    bins = {"_bt": ("_theme", 4), "_br": ("_trend", 4), "_bf": ("_flow", 3), "_bk": ("_risk", 3)}
    work = quantile_bin(work, bins, TARGET)
    valid = (c("_bt") >= 0) & (c("_br") >= 0) & (c("_bf") >= 0) & (c("_bk") >= 0)
    ident = c("_bt") * 36 + c("_br") * 9 + c("_bf") * 3 + c("_bk")
    work = work.withColumn("context_cluster_id", F.when(valid, ident).cast("double"))
    stats = {
        "_n": F.count(F.lit(1)),
        "_cs": F.avg(c("_theme") + c("_trend")),
        "_cm": F.avg("context_mf"),
        "_ch": F.avg("context_hp"),
    }
    work = group_values(work, ["target_trade_date", "context_cluster_id"], stats)
    member = c("context_cluster_id").isNotNull()
    only = lambda name: F.when(member, c(name))
    work = work.withColumn("context_cluster_size", only("_n").cast("double"))
    z = {
        "context_cluster_strength": only("_cs"),
        "context_cluster_mf": only("_cm"),
        "context_cluster_hp": only("_ch"),
    }
    work = robust_z(work, z, TARGET)
    return work.drop("_theme", "_trend", "_flow", "_risk", "_bt", "_br", "_bf", "_bk", "_n", "_cs", "_cm", "_ch")


def derive_context(df: DataFrame, min_peers: int = THEME_MIN_PEERS, industry: str = "industry") -> DataFrame:
    """All derived context from raw context."""
    work = _pullback_inputs(raw_scores(df))
    work = theme_context(work, min_peers, industry)
    return cluster_context(state_context(work))


def require_coverage(df: DataFrame, columns: Sequence[str] = CONTEXT_COLUMNS) -> None:
    """Raise if a context column that must have values has none."""
    needed = [c for c in columns if c not in MAY_BE_EMPTY]
    counts = df.agg(*[F.count(finite(c)).alias(c) for c in needed]).first()
    empty = [c for c in needed if counts[c] == 0]
    if empty:
        raise ValueError(f"context columns without values: {empty}")


def context_table(df: DataFrame) -> DataFrame:
    return df.select("sample_id", *CONTEXT_COLUMNS)


# -- trend features of predictions -----------------------------------------------------


def trend_features(price: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per entity and day, per industry and day, and per day: returns, range, volume, index excess.

    Industry and market levels are compounded from mean returns, one row per day.
    """
    work = price.withColumns(
        {
            "industry": F.coalesce(F.col("industry"), F.lit("")),
            "_ret": returns("close", 1),
            **{f"trend_roc{w}": returns("close", w) for w in (3, 5, 20, 60)},
            **_ranges(),
            "_vol20": ts_mean("volume", 20, 10),
        }
    )
    close = F.col("close")
    stock = work.select(
        "stock_code", "trade_date", "trend_roc3", "trend_roc5", "trend_roc20", "trend_roc60",
        (safe_div(close, "_high20") - 1.0).alias("trend_drawdown20"),
        safe_div(close - F.col("_low20"), F.col("_high20") - F.col("_low20")).alias("trend_rsv20"),
        (safe_div("volume", "_vol20") - 1.0).alias("trend_volume_ratio"),
        flag((close < F.col("_ma20")) & (close < F.col("_ma60"))).alias("trend_broken_ma"),
        F.col("amount").alias("trend_amount"),
    )
    daily = work.groupBy("industry", "trade_date").agg(F.avg("_ret").alias("_r"))
    level = daily.withColumn("_level", compounded("_r", "industry"))
    line = history("industry")
    rocs = {f"_i{w}": F.try_divide(F.col("_level"), F.lag("_level", w).over(line)) - 1.0 for w in (20, 60)}
    industry = level.withColumns(rocs)
    whole = work.groupBy("trade_date").agg(F.avg("_ret").alias("_r"))
    market_level = whole.withColumn("_level", compounded("_r", None))
    days = Window.orderBy("trade_date")
    market = market_level.select(
        "trade_date",
        *[(F.try_divide(F.col("_level"), F.lag("_level", w).over(days)) - 1.0).alias(f"trend_market_roc{w}") for w in (20, 60)],
    )
    joined = industry.join(market, "trade_date", "left")
    industry = joined.select(
        "industry", "trade_date",
        *[(F.col(f"_i{w}") - F.col(f"trend_market_roc{w}")).alias(f"trend_industry_excess{w}") for w in (20, 60)],
    )
    return stock, industry, market


def attach_trend(df: DataFrame, price: DataFrame, flow: DataFrame | None = None) -> DataFrame:
    """Predictions with trend features of their feature date and the flow ratio."""
    require_columns(df, ["stock_code", "industry", "feature_asof_date"], "predictions")
    stock, industry, market = trend_features(price)
    asof = lambda t: t.withColumnRenamed("trade_date", "feature_asof_date")
    work = df.join(asof(stock), ["stock_code", "feature_asof_date"], "left")
    work = work.join(asof(industry), ["industry", "feature_asof_date"], "left")
    work = work.join(asof(market), "feature_asof_date", "left")
    net = F.lit(None).cast("double")
    if flow is not None:
        side = flow.select("stock_code", F.col("trade_date").alias("feature_asof_date"), "net_mf_amount")
        work = work.join(side, ["stock_code", "feature_asof_date"], "left")
        net = number("net_mf_amount")
    return work.withColumn("trend_mf_ratio", safe_div(net, "trend_amount"))
