"""Prediction samples: labels, live rows, and the inputs of a training or inference run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalar import finite
from tidepanel.functions.text import sample_id
from tidepanel.operators.keys import keep_last, require_columns
from tidepanel.operators.joins import feature_panel
from tidepanel.operators.timeseries import forward_return, history
from tidepanel.operators.ordered import exact_quantiles
from tidepanel.scale import settled

# Fixed value: decisions are made at 09:25 of the target day.
DECISION_MINUTE = 9 * 60 + 25


def decision_time(date: str) -> Column:
    """The decision time of a target date."""
    return F.col(date).cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(DECISION_MINUTE))


def prediction_samples(panel: DataFrame) -> DataFrame:
    """One row per entity and target day, with the label from the next to the second next day.

    Features belong to ``feature_asof_date``, the day before the target. Rows
    without both later days are dropped.
    """
    ahead = history()
    columns = {
        "feature_asof_date": F.col("trade_date"),
        "target_trade_date": F.lead("trade_date", 1).over(ahead),
        "label_start_date": F.lead("trade_date", 1).over(ahead),
        "label_end_date": F.lead("trade_date", 2).over(ahead),
    }
    for field, label in (("open", "label_next_open_return"), ("vwap", "label_next_vwap_return")):
        if field in panel.columns:
            columns[label] = forward_return(field)
    work = panel.withColumns(columns).dropna(subset=["target_trade_date", "label_end_date"])
    return work.withColumns(
        {
            "trade_date": F.col("target_trade_date"),
            "decision_ts": decision_time("target_trade_date"),
            "sample_id": sample_id("stock_code", "target_trade_date"),
        }
    )


def live_samples(samples: DataFrame, panel: DataFrame, target, context_start) -> DataFrame:
    """History plus unlabelled rows for days after the last official one, up to the target day.

    Each panel day after the newest ``feature_asof_date`` and before the target
    gives rows for the next day of the calendar (panel days and the target). Of
    two rows with one sample_id the live one stays.
    """
    require_columns(samples, ("sample_id", "stock_code", "feature_asof_date", "target_trade_date"), "samples")
    target_day, first_day = F.lit(str(target)).cast("date"), F.lit(str(context_start)).cast("date")
    past = samples.where(F.col("target_trade_date").between(first_day, target_day))
    official = samples.agg(F.max("feature_asof_date")).scalar()
    one = panel.select(F.col("trade_date").cast("date").alias("_day")).distinct()
    calendar = one.union(samples.sparkSession.range(1).select(target_day.alias("_day"))).distinct()
    following = calendar.select("_day", F.lead("_day").over(Window.orderBy("_day")).alias("_next"))
    fresh = following.where((F.col("_day") > official) & (F.col("_day") < target_day) & (F.col("_next") <= target_day))
    rows = panel.join(fresh, F.col("trade_date").cast("date") == F.col("_day"))
    made = {
        "sample_id": sample_id("stock_code", "_next"),
        "stock_code": F.col("stock_code"),
        "stock_name": F.col("stock_name") if "stock_name" in panel.columns else F.lit(""),
        "industry": F.col("industry") if "industry" in panel.columns else F.lit(""),
        "feature_asof_date": F.col("_day"),
        "target_trade_date": F.col("_next"),
        "trade_date": F.col("_next"),
        "decision_ts": decision_time("_next"),
    }
    live = rows.select(
        *[
            made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in samples.schema.fields
        ],
        F.lit(1).alias("_live"),
    )
    both = past.withColumn("_live", F.lit(0)).unionByName(live)
    return keep_last(both, ["sample_id"], ["_live"]).drop("_live")


def inference_table(
    samples: DataFrame, blocks: Sequence[DataFrame], features: Sequence[str], target, labels: bool = False
) -> DataFrame:
    """Samples of one target day with chosen features; labels only on request."""
    day = samples.where(F.col("target_trade_date") == F.lit(str(target)).cast("date"))
    meta = [c for c in day.columns if labels or not c.startswith("label_")]
    return day.select(*meta).join(feature_panel(blocks, features, day), "sample_id", "left")


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median, mean and standard deviation per feature, from the rows given (the train split).

    A feature without finite values gets 0, 0 and 1; a deviation of next to
    nothing becomes 1. All features go through one long table.
    """
    long = train.select(*[finite(c).alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")
    long = settled(long.where(F.col("value").isNotNull()), "features")
    middle = exact_quantiles(long, ["feature"], "value", {"median": 0.5}).drop("total")
    spread = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    names = train.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    state = names.join(middle, "feature", "left").join(spread, "feature", "left")
    return state.select(
        "feature",
        F.coalesce("median", F.lit(0.0)).alias("median"),
        F.coalesce("mean", F.lit(0.0)).alias("mean"),
        F.when(F.col("std") > 1e-12, F.col("std")).otherwise(F.lit(1.0)).alias("std"),
    )


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standardise features, missing values taken as the median; ``<name>_present`` marks real ones."""
    state = {r["feature"]: r for r in scaler.where(F.col("feature").isin(list(columns))).collect()}
    missing = [c for c in columns if c not in state]
    if missing:
        raise ValueError(f"scaler lacks features: {missing}")
    results = {}
    for c in columns:
        s = state[c]
        results[f"{c}_present"] = finite(c).isNotNull()
        results[c] = (F.coalesce(finite(c), F.lit(s["median"])) - s["mean"]) / (s["std"] or 1.0)
    return df.withColumns(results)
