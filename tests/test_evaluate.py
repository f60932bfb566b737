"""Factor evaluation: results against pandas, and how many rows are stored or moved for them."""

import datetime as dt
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.plans import evaluate as ev
from tidepanel.plans import select as se
from tidepanel.scale import freeze, stage_folder

FACTORS, LABELS = ["a", "b", "c"], ["u", "v"]


def samples(spark, n: int):
    """Half of the samples on one day; ``a`` has many ties and one value of a third of the rows, ``c`` is constant, all have gaps."""
    h = lambda seed, m: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("double")
    gap = lambda seed, x: F.when(h(seed, 11) > 0, x)
    day = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 5)
    return spark.range(n).select(
        F.concat(F.lit("s"), F.lpad(F.pmod(F.col("id") * 7919, F.lit(n)).cast("string"), 6, "0")).alias("sample_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("target_trade_date"),
        gap(1, F.when(h(2, 3) == 0, -0.0).otherwise(h(3, 7))).alias("a"), gap(4, h(5, 100_003) / 7).alias("b"), F.lit(1.0).alias("c"),
        gap(6, h(7, 9973) - 5000).alias("u"), gap(8, h(9, 4)).alias("v"),
    )


def stored_rows(spark, before: set) -> int:
    new = [p for p in Path(stage_folder(spark).removeprefix("file:")).iterdir() if p.name not in before]
    return sum(spark.read.parquet(str(p)).count() for p in new if any(p.glob("*.parquet")))


def stages(spark) -> set:
    return {p.name for p in Path(stage_folder(spark).removeprefix("file:")).iterdir()}


def test_daily_ic_of_a_hot_day_and_what_is_stored_for_it(spark):
    n = 6000
    panel = freeze(samples(spark, n), "panel")
    frame = panel.toPandas()
    before = stages(spark)
    long = ev.factor_label_rows(panel, FACTORS, LABELS)
    got = ev.daily_ic(long, 10, 5).toPandas().set_index(["factor_name", "label", "target_trade_date"])
    # the samples once, besides rows per group and cell; not every pair for each of its ranks
    assert stored_rows(spark, before) < 3 * n < len(FACTORS) * len(LABELS) * n
    groups = ev.group_returns(long, 10, 5).toPandas().set_index(["factor_name", "label", "target_trade_date", "group"]).sort_index()
    assert len(got) == len(FACTORS) * len(LABELS) * 5
    for f in FACTORS:
        for y in LABELS:
            for day, rows in frame.groupby("target_trade_date"):
                r, pairs = got.loc[(f, y, day)], rows.dropna(subset=[f, y]).sort_values([f, "sample_id"])
                assert (r.row_count, r.pair_count) == (len(rows), len(pairs))
                if f == "c":
                    assert pd.isna(r.ic) and pd.isna(r.rank_ic) and pd.isna(r.group_spread)
                    continue
                place = np.arange(len(pairs))
                group = np.maximum(1, -(-place * 5 // (len(pairs) - 1)))
                means = pairs[y].groupby(group).agg(["count", "mean"])
                assert r.ic == pytest.approx(pairs[f].corr(pairs[y])) and r.rank_ic == pytest.approx(pairs[f].rank().corr(pairs[y].rank()))
                assert r.group_spread == pytest.approx(means["mean"][5] - means["mean"][1])
                assert list(groups.loc[(f, y, day)]["count"]) == list(means["count"])
                assert list(groups.loc[(f, y, day)]["mean_return"]) == pytest.approx(list(means["mean"]))


def test_ranks_of_pairs_are_not_stored(spark):
    n = 4000
    panel = freeze(samples(spark, n), "panel")
    frame = panel.toPandas()
    names = ["a", "b", "u", "v"]
    listed = spark.createDataFrame([(x, y) for i, x in enumerate(names) for y in names[i + 1 :]] + [("a", "c")], "factor_a string, factor_b string")
    before = stages(spark)
    got = {(r.factor_a, r.factor_b): r for r in se.pair_correlation(panel, listed, [*names, "c"]).collect()}
    assert stored_rows(spark, before) < n
    assert got["a", "c"].corr is None and len(got) == 7
    for (x, y), r in got.items():
        both = frame[[x, y]].dropna()
        assert r.overlap_count == len(both) and (y == "c" or r.corr == pytest.approx(both[x].rank().corr(both[y].rank())))


def test_quality_stores_a_row_per_sample(spark):
    n = 3000
    panel = freeze(samples(spark, n), "panel")
    odd = F.when(F.col("b") < 2000, "n/a").when(F.col("b") < 4000, "NaN").when(F.col("b") < 6000, "Infinity").otherwise(F.col("b").cast("string"))
    block = panel.select("sample_id", *FACTORS, odd.alias("text"), F.col("a").cast("float").alias("single"))
    known = panel.where(F.col("sample_id") > "s000999")
    before = stages(spark)
    out = ev.factor_quality(block, known, [*FACTORS, "text", "single"], 0.98, 100, 0.01)
    assert stored_rows(spark, before) < 2 * n
    got = out.toPandas().set_index("factor_name")
    frame = panel.toPandas()
    frame = frame[frame.sample_id > "s000999"]
    for f in (*FACTORS, "text", "single"):
        x = frame["a" if f == "single" else "b" if f == "text" else f]
        below = lambda low, high: int(((x >= low) & (x < high)).sum())
        if f == "text":
            assert (got.non_numeric_count[f], got.inf_count[f]) == (below(-1, 2000), below(4000, 6000))
            assert got.raw_nan_count[f] == below(2000, 4000) + x.isna().sum()
            x = x.where(x >= 6000)
        else:
            assert (got.non_numeric_count[f], got.inf_count[f], got.raw_nan_count[f]) == (0, 0, x.isna().sum())
        assert (got.row_count[f], got.non_missing_count[f], got.unique_count[f]) == (2000, x.count(), x.nunique())
        assert got.p50[f] == pytest.approx(x.median()) and got["mean"][f] == pytest.approx(x.mean())


def test_both_labels_read_one_summary(spark):
    quality = spark.createDataFrame([("a", True, False)], "factor_name string, quality_pass boolean, constant_flag boolean")
    days = freeze(spark.createDataFrame([("a", y, dt.date(2024, 1, d), 9, 1.0, 0.1 * d, 0.2 * d, 0.3) for y in LABELS for d in (1, 2)],
                  "factor_name string, label string, target_trade_date date, pair_count long, coverage double, ic double, rank_ic double, group_spread double"), "days")
    merged = se.merge_reports(quality, ev.factor_summary(days), *LABELS)
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 0
    row = merged.first()
    assert (row.label, row.rank_ic_mean, row.secondary_rank_ic_mean) == ("u", pytest.approx(0.3), pytest.approx(0.3))
