"""Score blending: from prediction heads and context to one score per row and day."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalar import clip, finite, flag, logit, sigmoid
from tidepanel.operators.cross_section import (
    LOWEST_SCORE,
    TARGET,
    daily_zscore,
    first_rank,
    group_values,
    in_top,
    cs_pct_rank,
    robust_z,
    top_floor_guard,
)
from tidepanel.operators.keys import require_columns, tradable_universe
from tidepanel.scale import null_safe_join, settled

# Weights of the heads and components in each score.
MULTIHEAD = {"final_score": 0.62, "y_score": 0.10, "return_pred": 0.22, "direction_logit": 0.06}
LINEAR = {
    "context_a4": {
        "F": 0.50, "Y": 0.06, "R": 0.16, "D_eff": 0.06, "NEWS": 0.07, "TR": 0.07, "OH": -0.05, "BR": -0.08, "CAP": 0.03,
    },
    "context_a4_no_news": {
        "F": 0.53, "Y": 0.06, "R": 0.17, "D_eff": 0.06, "TR": 0.08, "OH": -0.06, "BR": -0.09, "CAP": 0.03,
    },
    "context_s1": {
        "F": 0.50, "Y": 0.15, "R": 0.18, "D_eff": 0.07, "MF": 0.08, "NEWS": 0.05, "TR": 0.07, "HP": 0.06, "OH": -0.12,
        "BR": -0.20, "CAP": 0.03,
    },
    "context_s2": {
        "F": 0.42, "Y": 0.08, "R": 0.18, "D_eff": 0.04, "TR": 0.12, "HP": 0.15, "MF": 0.10, "NEWS": 0.06, "OH": -0.10,
        "BR": -0.28, "CAP": 0.03,
    },
    "context_s2_no_news": {
        "F": 0.45, "Y": 0.08, "R": 0.19, "D_eff": 0.04, "TR": 0.13, "HP": 0.16, "MF": 0.11, "OH": -0.11, "BR": -0.30,
        "CAP": 0.03,
    },
    "context_s3": {
        "F": 0.38, "Y": 0.12, "R": 0.25, "D_eff": 0.10, "MF": 0.08, "TR": 0.07, "HP": 0.06, "NEWS": 0.05, "OH": -0.10,
        "BR": -0.22,
    },
    "context_theme_s2": {
        "F": 0.36, "Y": 0.07, "R": 0.17, "D_eff": 0.04, "TR": 0.09, "THEME": 0.16, "HP": 0.10, "THEME_HP": 0.07,
        "MF": 0.09, "NEWS": 0.05, "OH": -0.10, "BR": -0.25, "CAP": 0.03,
    },
}
LINEAR["context_s5"] = LINEAR["context_s5_soft"] = LINEAR["exact_s5_soft"] = LINEAR["context_s2"]
OVERLAY = {"TR": 0.03, "MF": 0.02, "OH": -0.02, "BR": -0.03}
CLUSTER = {
    "CLUSTER": 0.45, "CLUSTER_MF": 0.18, "CLUSTER_HP": 0.18, "THEME": 0.10, "TR": 0.08, "CLUSTER_SIZE": 0.04,
    "OH": -0.10, "BR": -0.18,
}
RERANK_BASE = {"F": 0.60, "R": 0.20, "Y": 0.10, "D_eff": 0.10}
THEME_RERANK_BASE = {"F": 0.50, "R": 0.18, "Y": 0.08, "D_eff": 0.06, "THEME": 0.18}
CLUSTER_MIN_SIZE = 8
CLUSTER_BOOSTS = {"": 0.14, "strong": 0.22, "light": 0.08}
SIMPLE = {
    "return_pred": ("return_pred",),
    "direction_prob": ("direction_prob",),
    "z_y_plus_return": ("y_score", "return_pred"),
    "z_y_plus_direction": ("y_score", "direction_prob"),
    "z_all_equal": ("y_score", "return_pred", "direction_prob"),
}
CONTEXT_INPUTS = (
    "context_tr", "context_mf", "context_news", "context_oh", "context_br", "context_hp", "context_h", "context_cap",
)
EXACT_INPUTS = (
    "context_roc3", "context_roc5", "context_roc20", "context_roc60", "context_rsv20", "context_volume_ratio",
    "context_news_exact", "context_log_total_mv", "context_broken_ma",
)


@dataclass(frozen=True)
class ScoreParams:
    """How rows are scored and which rows may be traded."""

    variant: str = "y_score"
    weight_y: float = 1.0
    weight_return: float = 0.0
    weight_direction: float = 0.0
    weight_cap: float = 0.0
    cap_min_pct: float = 0.0
    cap_bonus: float = 0.0
    exclude_special: bool = False
    exclude_bj: bool = False


def needs_context(variant: str) -> bool:
    return variant.startswith(("context_", "exact_", "direct_theme_"))


def weighted_sum(weights: Mapping[str, float], prefix: str = "") -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(f"{prefix}{name}") * weight
    return total


def _raw_score(df: DataFrame) -> str:
    return "raw_y_score" if "raw_y_score" in df.columns else "y_score"


def _final_score(df: DataFrame) -> str:
    return "final_score" if "final_score" in df.columns else "y_score"


def _filled(df: DataFrame, name: str) -> Column:
    return F.coalesce(finite(name), F.lit(0.0)) if name in df.columns else F.lit(0.0)


# -- components ----------------------------------------------------------------------


def context_components(df: DataFrame) -> DataFrame:
    """Add ``c_`` components: heads as robust z-scores, context with gaps as zero.

    A bearish direction counts less the healthier a row is.
    """
    require_columns(df, CONTEXT_INPUTS, "context")
    heads = {
        "_d": logit(finite("direction_prob")) if "direction_prob" in df.columns else F.lit(None).cast("double"),
        "c_F": F.col(_final_score(df)),
        "c_Y": F.col(_raw_score(df)),
        "c_R": F.col("return_pred") if "return_pred" in df.columns else F.lit(None).cast("double"),
    }
    if "context_cluster_size" in df.columns:
        heads["c_CLUSTER_SIZE"] = F.col("context_cluster_size")
    work = robust_z(df, heads, TARGET)
    health = F.coalesce(clip(finite("context_h"), 0.0, 1.0), F.lit(0.0))
    unit = lambda name: F.coalesce(clip(finite(name), 0.0, 1.0), F.lit(0.0))
    columns = {
        "c_D_eff": clip("_d", lower=0.0) + (1.0 - health) * clip("_d", upper=0.0),
        "c_TR": _filled(df, "context_tr"),
        "c_MF": _filled(df, "context_mf"),
        "c_NEWS": _filled(df, "context_news"),
        "c_HP": _filled(df, "context_hp"),
        "c_OH": unit("context_oh"),
        "c_BR": unit("context_br"),
        "c_CAP": _filled(df, "context_cap"),
        "c_THEME": _filled(df, "context_theme_strength"),
        "c_THEME_HP": _filled(df, "context_theme_hp"),
        "c_CLUSTER": _filled(df, "context_cluster_strength"),
        "c_CLUSTER_MF": _filled(df, "context_cluster_mf"),
        "c_CLUSTER_HP": _filled(df, "context_cluster_hp"),
    }
    if "c_CLUSTER_SIZE" not in heads:
        columns["c_CLUSTER_SIZE"] = F.lit(0.0)
    return work.withColumns(columns).drop("_d")


def exact_components(df: DataFrame) -> DataFrame:
    """Add ``c_`` components computed from raw price context."""
    require_columns(df, EXACT_INPUTS, "exact context")
    z = {f"_{n}": F.col(f"context_{n}") for n in ("roc3", "roc5", "roc20", "roc60", "rsv20", "volume_ratio")}
    heads = {
        "c_F": F.col(_final_score(df)),
        "c_Y": F.col(_raw_score(df)),
        "c_R": F.col("return_pred"),
        "c_D_eff": logit(finite("direction_prob")),
        "c_NEWS": F.col("context_news_exact"),
        "c_CAP": F.col("context_log_total_mv"),
    }
    work = robust_z(df, {**z, **heads}, TARGET)
    c = F.col
    heat = c("_roc3") * 0.80 + c("_roc5") * 0.80 + c("_rsv20") * 0.50 + c("_volume_ratio") * 0.30
    broken = _filled(df, "context_broken_ma") - c("_roc20") * 0.60 - c("_roc60") * 0.40
    return work.withColumns(
        {
            "c_TR": c("_roc20") * 0.55 + c("_roc60") * 0.35 - c("_rsv20") * 0.10,
            "c_MF": F.lit(0.0),
            "c_HP": F.lit(0.0),
            "c_OH": sigmoid(heat),
            "c_BR": sigmoid(broken),
        }
    ).drop(*z)


def trend_components(df: DataFrame) -> DataFrame:
    """Add ``c_`` components of the pullback score from ``trend_`` columns, in three levels of z-scores."""
    c = F.col
    first = {
        f"_{n}": c(f"trend_{n}")
        for n in ("roc3", "roc5", "roc20", "roc60", "industry_excess20", "industry_excess60", "mf_ratio", "rsv20", "volume_ratio")
    }
    first |= {
        "_neg3": -c("trend_roc3"),
        "_neg5": -c("trend_roc5"),
        "c_D": logit(finite("direction_prob")),
        "c_F": c(_final_score(df)),
        "c_Y": c(_raw_score(df)),
        "c_R": c("return_pred"),
    }
    if "news_count" in df.columns:
        first["c_NEWS"] = c("news_count")
    if "log_total_mv" in df.columns:
        first["c_CAP"] = c("log_total_mv")
    work = robust_z(df, first, TARGET)
    severe = flag((c("trend_roc5") < -0.12) | (c("trend_drawdown20") < -0.18))
    strength = c("_roc20") * 0.55 + c("_roc60") * 0.35 + c("_industry_excess20") * 0.30 + c("_industry_excess60") * 0.15
    heat = c("_roc3") * 0.80 + c("_roc5") * 0.80 + c("_rsv20") * 0.50 + c("_volume_ratio") * 0.40 - c("_mf_ratio") * 0.30
    broken = (
        c("_roc20") * -0.70 - c("_roc60") * 0.50 - c("_mf_ratio") * 0.50 - c("_industry_excess20") * 0.40
        + _filled(df, "trend_broken_ma") * 0.80 + severe * 0.50
    )
    work = robust_z(work, {"c_TR": strength, "c_OH": heat, "c_BR": broken}, TARGET)
    pullback = (clip("_neg3", 0.0, 1.5) + clip("_neg5", 0.0, 1.5)) / 2.0
    healthy = (
        c("c_TR") * 0.55 + pullback * 0.45 + c("_mf_ratio") * 0.25
        - clip("c_OH", lower=0.0) * 0.25 - clip("c_BR", lower=0.0) * 0.40
    )
    work = robust_z(work, {"c_HP": healthy}, TARGET)
    positive = clip("c_HP", 0.0, 2.0) / 2.0
    columns = {
        "c_MF": c("_mf_ratio"),
        "c_D_eff": clip("c_D", lower=0.0) + (1.0 - positive) * clip("c_D", upper=0.0),
    }
    columns |= {n: F.lit(0.0) for n in ("c_NEWS", "c_CAP") if n not in first}
    return work.withColumns(columns).drop(*[n for n in first if n.startswith("_")])


def pullback_score(df: DataFrame, out: str = "score") -> DataFrame:
    """Trend and pullback score from ``trend_`` columns."""
    work = trend_components(df).withColumn(out, weighted_sum(LINEAR["context_s2"], "c_"))
    return work.drop(*[n for n in work.columns if n.startswith("c_")])


# -- scores --------------------------------------------------------------------------


def _multihead(df: DataFrame, out: str, score: str) -> DataFrame:
    """Weighted z-scores of all heads; ``score`` stands for the raw score head."""
    heads = {
        "_z_final_score": finite("final_score"),
        "_z_y_score": finite(score),
        "_z_return_pred": finite("return_pred"),
        "_z_direction_logit": logit(finite("direction_prob")),
    }
    work = daily_zscore(df, heads, TARGET)
    return work.withColumn(out, weighted_sum(MULTIHEAD, "_z_")).drop(*heads)


def score_by(
    df: DataFrame, params: ScoreParams, out: str = "score", row_id: str = "sample_id"
) -> DataFrame:
    """Add the score of a variant; a missing score and rows below the cap limit are at the bottom."""
    variant = params.variant or "y_score"
    if variant in ("y_score", "final_score"):
        work = df.withColumn(out, finite(variant))
    elif variant in SIMPLE:
        heads = SIMPLE[variant]
        work = daily_zscore(df, {f"_z_{h}": h for h in heads}, TARGET)
        work = work.withColumn(out, weighted_sum(dict.fromkeys(heads, 1.0), "_z_")).drop(*[f"_z_{h}" for h in heads])
    elif variant == "direct_multihead":
        work = _multihead(df, out, "y_score")
    elif variant == "weighted":
        weights = {"y_score": params.weight_y, "return_pred": params.weight_return, "direction_prob": params.weight_direction}
        if params.weight_cap:
            weights["log_total_mv"] = params.weight_cap
        require_columns(df, list(weights), "score")
        work = daily_zscore(df, {f"_z_{h}": h for h in weights}, TARGET)
        work = work.withColumn(out, weighted_sum(weights, "_z_")).drop(*[f"_z_{h}" for h in weights])
    elif needs_context(variant):
        work = exact_components(df) if variant.startswith("exact_") else context_components(df)
        work = _context_score(work, variant, out, row_id)
        work = work.drop(*[n for n in work.columns if n.startswith("c_")])
    else:
        raise ValueError(f"unknown score variant: {variant}")
    return _limit_by_cap(work, params, out)


def _limit_by_cap(work: DataFrame, params: ScoreParams, out: str) -> DataFrame:
    if params.cap_bonus:
        require_columns(work, ["log_total_mv"], "cap bonus")
        work = daily_zscore(work, {"_z_cap": "log_total_mv"}, TARGET)
        work = work.withColumn(out, F.col(out) + F.col("_z_cap") * params.cap_bonus).drop("_z_cap")
    score = F.col(out)
    if params.cap_min_pct > 0:
        require_columns(work, ["cap_pct"], "cap limit")
        score = F.when(F.coalesce(finite("cap_pct"), F.lit(0.0)) >= params.cap_min_pct, score).otherwise(LOWEST_SCORE)
    return work.withColumn(out, F.coalesce(finite(score), F.lit(LOWEST_SCORE)))


def _context_score(work: DataFrame, variant: str, out: str, row_id: str) -> DataFrame:
    c = F.col
    if variant.startswith("direct_theme_"):
        theme = 0.12 if variant == "direct_theme_medium" else 0.06
        work = _multihead(work, "_base", _raw_score(work))
        overlaid = c("_base") + weighted_sum({"THEME": theme, **OVERLAY}, "c_")
        if variant in ("direct_theme_soft", "direct_theme_medium"):
            return work.withColumn(out, overlaid).drop("_base")
        work = work.withColumn("_base", overlaid)
        if variant.startswith("direct_theme_soft_cluster_boost"):
            return _cluster_boost(work, _boost(variant), out)
        if variant.startswith("direct_theme_soft_cluster"):
            return _cluster_round_robin(work, _cluster_count(variant), out, row_id)
    elif variant == "context_s3":
        guard = (
            (c("c_R") < -0.8) & F.coalesce(finite("direction_prob") < 0.48, F.lit(False))
            & F.coalesce(finite("context_h") < 0.5, F.lit(False))
        )
        work = work.withColumn(out, weighted_sum(LINEAR[variant], "c_"))
        return top_floor_guard(work, out, guard, 40, TARGET, row_id)
    elif variant == "context_s5_rerank":
        work = work.withColumn("_base", weighted_sum(RERANK_BASE, "c_"))
        work = in_top(work, "_base", 80, "_in", TARGET, row_id)
        confirmed = (c("c_F") > 2.0) & (c("c_R") > 1.0) & (c("c_MF") > 0.8) & (c("c_NEWS") > 0.0)
        return _reranked(
            work, LINEAR["context_s2"], c("_in"), (c("c_BR") > 0.75) & ~confirmed,
            (c("c_OH") > 0.80) & (c("c_HP") < 0.3), out,
        ).drop("_base", "_in")
    elif variant == "context_theme_s5_rerank":
        work = work.withColumn("_base", weighted_sum(THEME_RERANK_BASE, "c_"))
        work = in_top(work, "_base", 100, "_in", TARGET, row_id)
        work = in_top(work, "c_THEME", 80, "_theme", TARGET, row_id)
        confirmed = ((c("c_F") > 1.5) & (c("c_R") > 0.6) & (c("c_MF") > 0.5)) | (
            (c("c_THEME") > 1.4) & (c("c_MF") > 0.2) & (c("c_BR") < 0.70)
        )
        return _reranked(
            work, LINEAR["context_theme_s2"], c("_in") | c("_theme"), (c("c_BR") > 0.78) & ~confirmed,
            (c("c_OH") > 0.85) & (c("c_THEME_HP") < 0.2) & (c("c_MF") < 0.2), out,
        ).drop("_base", "_in", "_theme")
    elif variant in LINEAR:
        return work.withColumn(out, weighted_sum(LINEAR[variant], "c_"))
    raise ValueError(f"unknown score variant: {variant}")


def _reranked(work, weights, candidate: Column, broken: Column, overheated: Column, out: str) -> DataFrame:
    score = F.when(candidate & ~broken, weighted_sum(weights, "c_")).otherwise(LOWEST_SCORE)
    return work.withColumn(out, F.when(overheated, score - 0.6).otherwise(score))


def _boost(variant: str) -> float:
    suffix = variant.removeprefix("direct_theme_soft_cluster_boost")
    return CLUSTER_BOOSTS[suffix] if suffix in CLUSTER_BOOSTS else float(suffix) / 100.0


def _cluster_count(variant: str) -> int:
    count = int(variant.removeprefix("direct_theme_soft_cluster") or 8)
    if count <= 0:
        raise ValueError(f"cluster count must be positive: {variant}")
    return count


def _ranked_clusters(work: DataFrame) -> DataFrame:
    """Add the row's own cluster score, whether its cluster counts, the cluster's place and their number.

    Clusters of a day are numbered by mean score; there are at most a few hundred
    a day, whatever the number of rows.
    """
    valid = F.col("context_cluster_id").isNotNull() & F.coalesce(F.col("context_cluster_size") >= CLUSTER_MIN_SIZE, F.lit(False))
    work = work.withColumns({"_own": weighted_sum(CLUSTER, "c_"), "_valid": valid})
    work = settled(work, "clusters")
    means = work.where("_valid").groupBy("target_trade_date", "context_cluster_id").agg(F.avg("_own").alias("_mean"))
    day = Window.partitionBy("target_trade_date")
    ranked = means.withColumns(
        {
            "_place": F.row_number().over(day.orderBy(F.col("_mean").desc(), "context_cluster_id")),
            "_number": F.count(F.lit(1)).over(day),
        }
    ).drop("_mean")
    return null_safe_join(work, ranked, ["target_trade_date", "context_cluster_id"])


def _cluster_boost(work: DataFrame, weight: float, out: str) -> DataFrame:
    work = _ranked_clusters(work)
    weak = F.col("_place") > F.greatest(F.lit(20), F.ceil(F.col("_number") * 0.75))
    bonus = F.col("_own") * weight + flag(F.col("_place") <= 8) * 0.04 - flag(weak) * 0.05
    score = F.when(F.col("_valid"), F.col("_base") + bonus).otherwise(F.col("_base"))
    return work.withColumn(out, score).drop("_own", "_valid", "_place", "_number", "_base")


def _cluster_round_robin(work: DataFrame, count: int, out: str, row_id: str) -> DataFrame:
    """Interleave the best clusters: the best row of each, then the second of each, and so on."""
    work = _ranked_clusters(work)
    chosen = F.col("_valid") & (F.col("_place") <= count)
    work = work.withColumns({"_chosen": chosen, "_inside": F.when(chosen, F.col("_base"))})
    keys = ("target_trade_date", "context_cluster_id")
    work = first_rank(work, "_inside", "_within", keys, row_id)
    work = group_values(work, TARGET, {"_any": F.max("_chosen")})
    place = -((F.col("_within") - 1) * float(max(count, 1)) + F.col("_place"))
    score = (
        F.when(F.col("_chosen"), place + F.col("_base") * 1e-4)
        .when(F.col("_any"), F.col("_base") - 10000.0)
        .otherwise(F.col("_base"))
    )
    helpers = ["_own", "_valid", "_place", "_number", "_base", "_chosen", "_inside", "_within", "_any"]
    return work.withColumn(out, score).drop(*helpers)


# -- strategy ------------------------------------------------------------------------


def attach_market_cap(df: DataFrame, metric: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Add market value at the as-of date, its log, and its percentile among the day's rows."""
    work = df
    if "feature_asof_date" not in df.columns:
        work = df.join(samples.select("sample_id", "feature_asof_date"), "sample_id", "left")
    side = metric.select("stock_code", F.col("trade_date").alias("feature_asof_date"), "total_mv", "circ_mv", "turnover_rate")
    work = work.join(side, ["stock_code", "feature_asof_date"], "left")
    work = work.withColumn("log_total_mv", F.ln(clip(finite("total_mv"), lower=1.0)))
    return cs_pct_rank(work, {"cap_pct": "log_total_mv"}, TARGET)


def prepare_predictions(
    df: DataFrame, params: ScoreParams, row_id: str = "sample_id"
) -> DataFrame:
    """Tradable rows with the strategy's score in ``y_score`` and their daily rank.

    Context or market-value columns that the score needs must be attached already;
    the cap percentile is taken among the rows that remain.
    """
    require_columns(df, ["target_trade_date", "stock_code", "y_score"], "predictions")
    work = tradable_universe(df, params.exclude_special, params.exclude_bj)
    if params.cap_min_pct > 0 and "cap_pct" not in work.columns:
        work = cs_pct_rank(work, {"cap_pct": "log_total_mv"}, TARGET)
    if "raw_y_score" not in work.columns:
        work = work.withColumn("raw_y_score", finite("y_score"))
    work = score_by(work, params, "_score", row_id)
    work = work.withColumns({"y_score": F.col("_score"), "strategy_score_variant": F.lit(params.variant)}).drop("_score")
    return first_rank(work, "y_score", "rank", TARGET, row_id)


