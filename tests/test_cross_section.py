import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidepanel.operators import cross_section as cs
from tidepanel.operators.ordered import add_rank, exact_quantiles, number_rows, running_totals
from tidepanel.scale import settled


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    n = 300
    pdf = pd.DataFrame(
        {
            "sample_id": [f"s{i:04d}" for i in range(n)],
            "target_trade_date": pd.to_datetime(rng.choice(["2024-01-01", "2024-01-02", "2024-01-03"], n, p=[0.7, 0.2, 0.1])).date,
            "x": np.where(rng.random(n) < 0.3, 0.0, np.round(rng.normal(size=n), 2)),
        }
    )
    pdf.loc[rng.random(n) < 0.1, "x"] = np.nan
    df = spark.createDataFrame(pdf.astype({"x": object}).where(pdf.notna(), None), "sample_id string, target_trade_date date, x double")
    return df, pdf


def by_id(df, name):
    return {r["sample_id"]: r[name] for r in df.select("sample_id", name).collect()}


def expected(series, ids):
    return {k: (None if pd.isna(v) else v) for k, v in zip(ids, series)}


def same(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k


def test_ranks(frame):
    df, pdf = frame
    out = cs.cs_rank(df, {"r": "x"}, cs.TARGET)
    same(by_id(out, "r"), expected(pdf.groupby("target_trade_date")["x"].rank(), pdf["sample_id"]))
    out = cs.cs_rank(df, {"r": "x"}, cs.TARGET, ascending=False, share=True)
    same(by_id(out, "r"), expected(pdf.groupby("target_trade_date")["x"].rank(pct=True, ascending=False), pdf["sample_id"]))


def test_robust_z(frame):
    df, pdf = frame

    def one(s):
        med = s.median()
        mad = (s - med).abs().median()
        scale = 1.4826 * mad if mad else s.std()
        return ((s - med) / scale).fillna(0.0).clip(-4, 4)

    want = pdf.groupby("target_trade_date")["x"].transform(one)
    same(by_id(cs.robust_z(df, {"z": "x"}), "z"), expected(want, pdf["sample_id"]))


def test_zscore_of_constant_section_is_missing(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 2.0), ("b", "2024-01-01", 2.0)], "k string, trade_date string, x double")
    assert [r.z for r in cs.cs_zscore(df, {"z": "x"}).collect()] == [None, None]
    filled = cs.daily_zscore(df, {"z": "x"}, ("trade_date",))
    assert [r.z for r in filled.collect()] == [0.0, 0.0]


def test_first_rank_and_top(frame):
    df, pdf = frame
    work = pdf.dropna().sort_values(["target_trade_date", "x", "sample_id"], ascending=[True, False, True])
    want = dict(zip(work["sample_id"], work.groupby("target_trade_date").cumcount() + 1))
    got = {k: v for k, v in by_id(cs.first_rank(df, "x"), "rank").items() if v is not None}
    assert got == want
    top = by_id(cs.in_top(df, "x", 5, "best"), "best")
    assert {k for k, v in top.items() if v} == {k for k, v in want.items() if v <= 5}


def test_quantile_bins_and_median_fill(frame):
    df, pdf = frame
    share = pdf.groupby("target_trade_date")["x"].rank(pct=True).clip(upper=0.999999)
    want = np.floor(share * 5).fillna(-1).astype(int)
    got = by_id(cs.quantile_bin(df, {"b": ("x", 5)}), "b")
    assert got == dict(zip(pdf["sample_id"], want))
    filled = pdf["x"].fillna(pdf.groupby("target_trade_date")["x"].transform("median"))
    same(by_id(cs.median_fill(df, ["x"], cs.TARGET), "x"), dict(zip(pdf["sample_id"], filled)))


def test_exact_quantiles_of_a_whole_table(frame):
    df, pdf = frame
    got = exact_quantiles(df, [], "x", {"a": 0.01, "b": 0.5, "c": 0.993}).first()
    assert [got.a, got.b, got.c] == pytest.approx(list(pdf["x"].quantile([0.01, 0.5, 0.993])))
    assert got.total == pdf["x"].notna().sum()


def test_winsorize_whole_table(frame):
    df, pdf = frame
    low, high = pdf["x"].quantile([0.05, 0.9])
    same(by_id(cs.winsorize(df, {"w": "x"}, 0.05, 0.9), "w"), expected(pdf["x"].clip(low, high), pdf["sample_id"]))


def hot_day(spark, rows=40_000):
    """A day with nearly all rows: half of them share a value, a tenth have none; and two small days."""
    x = F.when(F.col("id") % 10 == 9, None).when(F.col("id") % 2 == 0, 0.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(997)) / 100 - 4)
    day = F.when(F.col("id") < 7, "small").when(F.col("id") == 7, None).otherwise("hot")
    return spark.range(rows).repartition(8).select(F.col("id").cast("string").alias("sample_id"), day.alias("target_trade_date"), x.alias("x"), (x * 3 + F.col("id") % 7).alias("y"))


def test_ranks_of_a_hot_day_and_value(spark):
    df = hot_day(spark)
    got = cs.cs_rank(df, {"rx": "x", "ry": "y"}, cs.TARGET, row=["sample_id"]).toPandas()
    for c in ("x", "y"):
        assert np.allclose(got["r" + c].astype(float), got.groupby("target_trade_date", dropna=False)[c].rank(), equal_nan=True)
    down = cs.cs_pct_rank(df, {"r": "x"}, cs.TARGET, ascending=False).toPandas()
    assert np.allclose(down["r"].astype(float), down.groupby("target_trade_date", dropna=False)["x"].rank(ascending=False, pct=True), equal_nan=True)


def test_no_task_ranks_a_whole_day(spark):
    """Rows of the last exchange, with as many partitions as cuts: none has twice the median."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranked = add_rank(settled(hot_day(spark)), cs.TARGET, "x", "r")
        sizes = [r["count"] for r in ranked.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1 and max(sizes) <= 2 * np.median(sizes)
    assert "percentile(" not in ranked._jdf.queryExecution().toString()


def test_quantiles_and_robust_z_of_a_hot_day(spark):
    """Exact in a day of nearly all rows, where bounds from the sketch leave few of them, and in days of a few rows."""
    df = hot_day(spark)
    got = cs.robust_z(df, {"zx": "x", "zy": "y"}, quantiles={"q": ("y", 0.05)}).toPandas()
    by = got.groupby("target_trade_date", dropna=False)
    for c in ("x", "y"):
        x = got[c].astype(float)
        middle = by[c].transform("median")
        spread = (x - middle).abs().groupby(got["target_trade_date"], dropna=False).transform("median") * 1.4826
        spread = spread.where(spread > 0, by[c].transform("std"))
        z = ((x - middle) / spread).clip(-4, 4).fillna(0.0)
        assert np.allclose(got["z" + c], z)
    assert np.allclose(got["q"], by["y"].transform(lambda v: v.quantile(0.05)))
    filled = cs.median_fill(df, ["x"], cs.TARGET).toPandas()
    assert filled["x"].notna().all()


@pytest.mark.parametrize("n", [1, 2, 3, 8, 23, 24, 25, 119, 120, 500, 999, 1000, 1001, 2500])
def test_quantiles_at_every_bound(spark, n):
    values = np.random.default_rng(n).integers(0, max(2, n // 3), n).astype(float)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    shares = {"a": 0.0, "b": 0.01, "c": 0.05, "d": 0.5, "e": 0.9, "f": 1.0}
    got = exact_quantiles(settled(df), [], "x", shares).first()
    assert [got[k] for k in shares] == pytest.approx(list(np.quantile(values, list(shares.values()))))


def test_running_totals_over_ranges(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).alias("k"), F.col("id"), (F.col("id") % 11).alias("v"))
    got = running_totals(df, ["k"], ["id"], {"place": F.lit(1), "sum": F.col("v")}).toPandas().sort_values("id")
    for _, g in got.groupby("k"):
        assert list(g["place"]) == list(range(len(g))) and list(g["sum"]) == list(g["v"].cumsum() - g["v"])


def test_row_numbers_by_text_and_missing_key(spark):
    data = [("g", "b", 1), ("g", "a", 2), (None, "z", 3), (None, "y", 4), ("g", "a", 5), ("g", "c", 6)]
    df = spark.createDataFrame(data, "k string, t string, id int")
    out = number_rows(df, ["k"], [F.col("t")], "id", "n")
    assert {r.id: r.n for r in out.collect()} == {2: 1, 5: 2, 1: 3, 6: 4, 4: 1, 3: 2}


def test_top_floor_guard(spark):
    data = [(f"s{i}", "2024-01-01", float(i)) for i in range(10)]
    df = spark.createDataFrame(data, "sample_id string, target_trade_date string, score double")
    out = cs.top_floor_guard(df, "score", F.col("score") >= 8, 3)
    got = by_id(out, "score")
    assert got["s9"] == got["s8"] == pytest.approx(7 - 1e-6) and got["s7"] == 7.0


def test_ranks_of_numbered_rows_across_ranges(spark):
    """Values that many rows share end several ranges, so their ranks are counted over all of them; a missing key is a group."""
    df = spark.range(24_000).select(
        F.when(F.col("id") % 4 != 0, F.concat(F.lit("g"), (F.col("id") % 3).cast("string"))).alias("k"), F.col("id"),
        F.when(F.col("id") % 5 < 2, -0.0).when(F.col("id") % 5 == 2, 7.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(91)) / 7.0).alias("x"),
    )
    got = number_rows(df, ["k"], [F.col("x")], "id", "n", "all", "r").toPandas()
    assert len(got) == 24_000
    for _, g in got.groupby("k", dropna=False):
        assert list(g.sort_values("n")["id"]) == list(g.sort_values(["x", "id"])["id"]) and set(g["all"]) == {len(g)}
        assert np.array_equal(g["r"], g["x"].rank()) and sorted(g["n"]) == list(range(1, len(g) + 1))


def test_quantiles_are_counted_by_hash(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 != 0, F.pmod(F.xxhash64("id"), F.lit(997)) / 3.0).alias("x"))
    out = exact_quantiles(df, ["k"], "x", {"p05": 0.05, "p50": 0.5}, {"mean": F.avg("x"), "low": F.min("x")})
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    frame = df.toPandas().groupby("k")["x"]
    for r in out.collect():
        x = frame.get_group(r.k)
        assert (r.total, r.low) == (x.count(), x.min()) and r["mean"] == pytest.approx(x.mean())
        assert [r.p05, r.p50] == pytest.approx([x.quantile(0.05), x.quantile(0.5)])


def test_direction_and_blend(spark):
    data = [("a", "2024-01-01", 0.02, None), ("b", "2024-01-01", -0.02, 0.1), ("c", "2024-01-01", None, 0.3)]
    df = spark.createDataFrame(data, "sample_id string, target_trade_date string, x double, y double")
    out = cs.direction_label(df, "x", fixed_epsilon=0.005)
    assert rows(out.select("sample_id", "direction_target", "direction_valid"), "sample_id") == [
        ("a", 1.0, True), ("b", 0.0, True), ("c", 0.0, False)
    ]
    blended = df.select("sample_id", cs.blend_labels("x", "y", 0.25).alias("v"))
    assert [v for _, v in rows(blended, "sample_id")] == pytest.approx([0.02, 0.01, 0.3])


def test_a_large_section_is_split(spark):
    """One day with all rows, a third of them with one value: positions come from many ranges."""
    df = spark.range(30_000).select(
        F.col("id").cast("string").alias("sample_id"), F.lit("d").alias("target_trade_date"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(9973)).cast("double")).alias("x"),
    )
    ranged = number_rows(df, ["target_trade_date"], [F.col("x")], "sample_id", "n", "all")
    got = ranged.select("sample_id", "x", "n", "all").toPandas()
    assert set(got["all"]) == {30_000} and sorted(got["n"]) == list(range(1, 30_001))
    work = got.sort_values(["x", "sample_id"]).reset_index(drop=True)
    assert list(work["n"]) == list(range(1, 30_001))
    ranks = cs.cs_rank(df, {"r": "x"}, cs.TARGET).select("x", "r").toPandas()
    assert np.allclose(ranks["r"], ranks["x"].rank())


def test_bins_by_their_first_values_agree_with_ranks_and_rows_are_not_shuffled_for_them(spark, tmp_path):
    # ties that cross an edge, a value that most rows share, gaps, a tiny group and a NULL group
    value = F.when(F.col("g") == 0, (F.col("id") * 7 % 50).cast("double")).when(F.col("g") == 1, F.when(F.col("id") % 10 < 7, 5.0).otherwise(F.col("id").cast("double")))
    data = spark.range(3000).withColumn("g", F.when(F.col("id") < 5, 2).otherwise((F.col("id") % 2)).cast("int"))
    data = data.withColumn("x", F.when(F.col("id") % 13 != 0, F.coalesce(value, F.col("id").cast("double")))).withColumn("g", F.when(F.col("id") % 101 != 0, F.col("g")))
    data.write.parquet(str(tmp_path / "bins"))
    stored = spark.read.parquet(str(tmp_path / "bins"))
    binned = cs.quantile_bin(stored, {"b4": ("x", 4), "b3": ("x", 3)}, ["g"])
    ranked = cs.cs_pct_rank(binned, {"p": "x"}, ["g"])
    for name, bins in (("b4", 4), ("b3", 3)):
        expected = F.when(F.col("p").isNull(), -1).otherwise(F.floor(F.least("p", F.lit(0.999999)) * bins))
        assert ranked.where(F.col(name) != expected).count() == 0
    assert "Exchange hashpartitioning" not in binned._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in cs.robust_z(stored, {"z": "x"}, ["g"])._jdf.queryExecution().executedPlan().toString()
