import datetime as dt
import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidepanel.functions.text import parse_time
from tidepanel.operators.joins import align_to_samples, forward_trade_day
from tidepanel.operators.keys import hash_sample, keep_last, require_unique
from tidepanel.plans import blend as bl
from tidepanel.plans import catalogue as ct
from tidepanel.plans import flow_factors as ff
from tidepanel.plans import portfolio as po
from tidepanel.plans import predictions as pr
from tidepanel.plans import price_factors as pf
from tidepanel.plans import select as se
from tidepanel.plans import standardise as st
from tidepanel.plans import value_factors as vf
from tidepanel.plans.factor_table import append_neutral, catalog, combine, eligible_factors
from tidepanel.sources import readers as rd
from tidepanel.sources import sinks as sk
from tidepanel.streaming.daily_feed import append_new_files, new_daily_rows

D = dt.date


@pytest.fixture(scope="module")
def price(spark):
    data = [
        ("A", D(2024, 1, 1), 10.0, 12.0, 9.0, 11.0, 10.5, 100.0, 1000.0, "x"),
        ("A", D(2024, 1, 2), 11.0, 13.0, 10.0, 12.0, 11.5, 0.0, 1200.0, "x"),
        ("A", D(2024, 1, 3), 12.0, 12.0, 12.0, 12.0, 12.0, 150.0, 0.0, "x"),
        ("B", D(2024, 1, 1), 5.0, 6.0, 4.0, 4.0, 5.0, 10.0, 50.0, " "),
    ]
    return spark.createDataFrame(
        data,
        "stock_code string, trade_date date, open double, high double, low double, close double, vwap double, "
        "volume double, amount double, industry string",
    )


def test_price_factors(price):
    table = pf.price_factors(price, rolling_windows=(3,)).validate()
    assert len(table.names) == 9 + 16 + 6 + 28 and table.max_lookback() == 60
    row = table.df.where((F.col("stock_code") == "A") & (F.col("trade_date") == D(2024, 1, 3))).first()
    assert row["alpha158_KMID2"] == 0.0 and row["alpha158_OPEN2"] == pytest.approx(10 / 12)
    assert row["alpha158_MA3"] == pytest.approx(35 / 36) and row["alpha158_CNTP3"] is None
    assert row["alpha158_VMA3"] == pytest.approx((250 / 3) / 150)


def test_counts_of_default_families(price, spark):
    assert len(pf.price_factors(price).entries) == 171
    metric = price.select("stock_code", "trade_date", *[F.col("close").alias(c) for c in vf.RAW_FIELDS])
    assert len(vf.value_factors(metric).entries) == 58
    flow = price.select("stock_code", "trade_date", *[F.col("close").alias(c) for c in ff.FLOW_COLUMNS])
    table = ff.flow_factors(flow, price)
    assert len(table.entries) == 41
    day = table.df.where((F.col("stock_code") == "A") & (F.col("trade_date") == D(2024, 1, 3))).first()
    assert day["mf_net_amount_ratio"] is None  # nothing traded
    listed = catalog(spark, table.entries)
    assert listed.count() == 41 and listed.where("window is null").count() == 7


def test_neutral_forms_and_eligibility(price):
    table = pf.price_factors(price, relative=False, return_windows=(1,), rolling_windows=())
    full = append_neutral(table).validate()
    assert len(full.names) == 40
    assert full.entries[-1].category.endswith(".ind_neu") and "industry" in full.entries[-1].term.inputs
    assert full.df.where("stock_code = 'B'").first()["alpha158_KMID_ind_neu"] is None
    assert eligible_factors(table.df, ["alpha158_KMID", "alpha158_ROC1"], 0.25) == ["alpha158_KMID"]


def test_specs_and_tables_are_checked(price):
    table = pf.price_factors(price, relative=False, return_windows=(), rolling_windows=())
    with pytest.raises(ValueError, match="duplicate"):
        combine([table, table])
    with pytest.raises(KeyError):
        pf.price_factors(price.drop("vwap"))


def test_alignment_uses_the_feature_date(spark):
    samples = spark.createDataFrame([("s", "A", D(2024, 1, 1), D(2024, 1, 2))], "sample_id string, stock_code string, feature_asof_date date, target_trade_date date")
    daily = spark.createDataFrame([("A", D(2024, 1, 1), 1.0), ("A", D(2024, 1, 2), 2.0)], "stock_code string, trade_date date, f double")
    assert align_to_samples(samples, daily).first()["f"] == 1.0
    with pytest.raises(ValueError, match="unique"):
        align_to_samples(samples, daily.union(daily))
    with pytest.raises(ValueError, match="already"):
        align_to_samples(samples.withColumn("f", F.lit(0.0)), daily)


def test_forward_trade_day(spark):
    days = spark.createDataFrame([(D(2024, 1, 5),), (D(2024, 1, 8),)], "day date")
    times = [dt.datetime(2024, 1, 5, 14, 59), dt.datetime(2024, 1, 5, 15), dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 8, 15), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t timestamp_ntz")
    got = rows(forward_trade_day(df, days, "t").select("i", "trade_date"), "i")
    assert [d for _, d in got] == [D(2024, 1, 5), D(2024, 1, 8), D(2024, 1, 5), None, None]


def test_keep_last_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k int, o int")
    out = keep_last(df, ["k"], ["o"])
    assert rows(out, "k") == [(1, 2), (2, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    with pytest.raises(ValueError, match="unique"):
        require_unique(df, ["k"])


def test_hash_sample_is_stable(spark):
    df = spark.range(500).withColumn("k", F.col("id").cast("string"))
    one = rows(hash_sample(df, 20, "k").select("k"), "k")
    again = rows(hash_sample(df.repartition(7), 20, "k").select("k"), "k")
    assert one == again and len(one) == 20
    assert rows(hash_sample(df, 20, "k", seed=1).select("k"), "k") != one


def test_correlations_by_one_pass_over_the_samples(spark):
    """Ties, gaps and an unlisted factor: pairs and matrix against pandas, without meeting samples with themselves."""
    rng = random.Random(3)
    gap = lambda v: None if rng.random() < 0.2 else v
    data = [(f"s{i}", gap(float(rng.randrange(9))), gap(rng.random()), gap(float(rng.randrange(3)))) for i in range(400)]
    panel = spark.createDataFrame(data, "sample_id string, a double, b double, c double")
    pairs = spark.createDataFrame([("a", "b"), ("c", "a"), ("a", "zz")], "factor_a string, factor_b string")
    out = se.pair_correlation(panel, pairs, ["a", "b", "c"])
    frame = panel.toPandas().set_index("sample_id").astype(float)
    got = {(r.factor_a, r.factor_b): (r.corr, r.overlap_count) for r in out.collect()}
    assert got.keys() == {("a", "b"), ("c", "a")}
    for (x, y), (corr, n) in got.items():
        both = frame[[x, y]].dropna()
        assert n == len(both) and corr == pytest.approx(both.rank().corr()[x].loc[y])
    z = se.standardised(panel, ["a", "b", "c"]).toPandas().set_index("sample_id")
    ranks = frame.rank()
    assert abs(z - ((ranks - ranks.mean()) / ranks.std()).fillna(0.0).loc[z.index]).max().max() < 1e-9
    plan = se.standardised(panel, ["a", "b", "c"])._jdf.queryExecution().optimizedPlan().toString()
    assert "pivot" not in plan and plan.count("Aggregate [sample_id") == 1


def test_clusters_follow_chains(spark):
    names = [f"f{i:02d}" for i in range(12)]
    scored = spark.createDataFrame([(n, float(i), 1.0, "candidate", "") for i, n in enumerate(names)],
                                   "factor_name string, selection_score double, coverage_mean double, selection_status string, reject_reason string")
    chain = spark.createDataFrame([(names[i], names[i + 1], 0.97) for i in range(0, 8)], "factor_a string, factor_b string, corr double")
    groups = se.redundancy_clusters(scored, chain)
    got = {r.factor_name: (r.cluster_id, r.representative, r.cluster_size) for r in groups.collect()}
    assert all(got[n] == ("cluster_0001", "f08", 9) for n in names[:9])
    assert got["f09"] == ("cluster_0002", "f09", 1)
    picked = {r.factor_name: (r.selected, r.final_reject_reason, r.corr_with_selected) for r in se.final_pick(scored, groups, chain).collect()}
    assert picked["f08"][0] and picked["f11"][0]
    assert picked["f07"] == (False, "high_corr_with:f08", 0.97) and picked["f00"][2] is None


def test_review_rules(spark):
    known = spark.createDataFrame([("a", True, False), ("b", False, False), ("c", True, False)], "factor_name string, quality_pass boolean, constant_flag boolean")
    review = spark.createDataFrame(
        [("remove", "c", None, "r"), ("add_back", "b", None, "r"), ("add_back", "a", None, "r"), ("remove", "zz", None, "r"),
         ("flag", "a", "odd", "r"), ("flag", "a", "other", " ")],
        "action string, factor_name string, flag string, reason string",
    )
    got = {(r.action, r.factor_name, r.flag): r.rule for r in se.review_problems(known, known.where("factor_name = 'a'"), review).collect()}
    assert got == {
        ("remove", "c", None): "not selected", ("add_back", "b", None): "quality failed", ("add_back", "a", None): "already selected",
        ("remove", "zz", None): "unknown factor", ("flag", "a", "odd"): "unknown flag", ("flag", "a", "other"): "no reason",
    }


def test_signals_against_positions(spark):
    data = [(D(2024, 1, 2), c, s) for c, s in (("A", 0.9), ("B", 0.8), ("C", 0.7), ("D", 0.1), ("E", 0.05))] + [(D(2024, 1, 1), "A", 0.0)]
    df = spark.createDataFrame(data, "target_trade_date date, stock_code string, y_score double")
    held = spark.createDataFrame([("C", 0.5), ("D", 0.5), ("X", 0.0)], "stock_code string, weight double")
    out = po.trade_signals(df, held, top_n=2, replace_k=1)
    got = {r.stock_code: (r.suggested_action, r.target_weight) for r in out.collect()}
    assert got == {"A": ("buy", 0.5), "B": ("watch", 0.0), "C": ("hold", 0.5), "D": ("sell", 0.0), "E": ("watch", 0.0)}
    first = {r.stock_code: r.suggested_action for r in po.trade_signals(df, None, 2, 1).collect()}
    assert [c for c, a in first.items() if a == "buy"] == ["A", "B"]


def test_round_robin_order(spark):
    base = {"target_trade_date": "2024-01-02", "return_pred": 0.0, "direction_prob": 0.5}
    names = ["A1", "A2", "B1", "B2", "C1", "C2"]
    context = {c: 0.0 for c in (*bl.CONTEXT_INPUTS, "context_theme_strength", "context_theme_hp", "context_cluster_mf", "context_cluster_hp")}
    data = [
        {**base, **context, "sample_id": n, "stock_code": n, "y_score": s, "final_score": s, "context_cluster_id": float("ABC".index(n[0])),
         "context_cluster_size": 8.0, "context_cluster_strength": {"A": 3.0, "B": 2.0, "C": 1.0}[n[0]]}
        for n, s in zip(names, (2.0, 1.0, 5.0, 4.0, 9.0, 8.0))
    ]
    df = spark.createDataFrame(data)
    out = bl.prepare_predictions(df, bl.ScoreParams("direct_theme_soft_cluster2"))
    assert [r[0] for r in rows(out.select("sample_id", "rank"), "rank")][:4] == ["A1", "B1", "A2", "B2"]


def test_ensemble_ignores_row_order(spark):
    schema = "sample_id string, target_trade_date string, final_score double, direction_prob double"
    a = spark.createDataFrame([("x", "d", 1.0, 0.2), ("y", "d", 2.0, 0.4), ("z", "d", 3.0, 0.9)], schema)
    b = spark.createDataFrame([("y", "d", 20.0, 0.6), ("x", "d", 10.0, 0.4)], schema)
    got = rows(pr.ensemble([a, b]).select("sample_id", "direction_prob", "rank"), "sample_id")
    assert [(i, pytest.approx(p), r) for i, p, r in got] == [("x", 0.3, 2), ("y", 0.5, 1)]


def test_nav_and_windows(spark):
    data = [(D(2024, 1, d), c, s, r) for d in (1, 2, 3, 4) for c, s, r in (("A", 1.0 * d, 0.1), ("B", 2.5, -0.1), ("C", 0.0, 0.3))]
    df = spark.createDataFrame(data, "target_trade_date date, stock_code string, y_score double, label_next_open_return double")
    held = po.holdings(df, 1)
    moved = po.turnover(held, 1)
    assert [r.turnover for r in moved.orderBy("target_trade_date").collect()] == [1.0, 0.0, 2.0, 0.0]
    values = po.nav(held, moved, 100.0).orderBy("target_trade_date").collect()
    assert values[0].nav == pytest.approx(100 * (1 - 0.1 - 0.0008))
    orders = rows(po.daily_orders(po.trades(held)).select("target_trade_date", "buy_stock_codes", "sell_stock_codes", "buy_weights"), "target_trade_date")
    assert orders == [(D(2024, 1, 1), "B", "", "B:1.000000"), (D(2024, 1, 3), "A", "B", "A:1.000000")]
    windows = rows(po.date_windows(df, 2, 2), "window_id", "target_trade_date")
    assert [(w, d.day) for w, d, *_ in windows] == [(1, 1), (1, 2), (2, 3), (2, 4)]


def test_feature_groups(spark):
    data = [("alpha158_MA5", "alpha158_rolling5_sample"), ("alpha158_low1", None), ("mf_x", None), ("news_a", None), ("q", "gpt_mined_reversal_sample"), ("q", "gpt_mined_new_sample"), ("q", None)]
    df = spark.createDataFrame(data, "f string, b string")
    got = [r[0] for r in df.select(ct.feature_group(F.col("f"), F.col("b"))).collect()]
    assert got == ["alpha158_rolling", "alpha158_price", "moneyflow", "news", "reversal", "new", "other"]


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_raw_files_to_standard_tables(spark, tmp_path):
    write(tmp_path / "raw/daily/20240102.csv", "ts_code,trade_date,stock_name,open,close,vwap,vol,amount\n600000.SH,20240102,浦发 银行,10,10.5,10.2,100,1000\n830001.BJ,20240102,北 交,1,1,1,1,1\n")
    write(tmp_path / "raw/daily/20240103.csv", "ts_code;trade_date;stock_name;open;close;vwap;vol;amount\n600000.SH;20240103;浦发银行;;11;10.8;;\n")
    write(tmp_path / "raw/daily/20240104.csv", "ts_code,trade_date,stock_name,open,close,vwap,vol,amount\n600000.SH,20240104,浦发银行,12,12,12,5,60\n")
    write(tmp_path / "raw/news/n.csv", "datetime,title,content\n2024-01-02 16:00:00,浦发银行公告,内容\n")
    basic = write(tmp_path / "basic.csv", "ts_code,stock_name,industry,market\n600000.SH,浦发银行,银行,主板\n")
    raw = st.read_raw(spark, str(tmp_path / "raw"), [basic])
    out = st.standardise(raw)
    bars = rows(out.price.select("trade_date", "open", "volume", "industry", "stock_name"), "trade_date")
    assert bars == [
        (D(2024, 1, 2), 10.0, 100.0, "银行", "浦发银行"), (D(2024, 1, 3), 10.0, 0.0, "银行", "浦发银行"), (D(2024, 1, 4), 12.0, 5.0, "银行", "浦发银行")
    ]
    sample = out.samples.first()
    assert sample.sample_id == "600000.SH_2024-01-03" and sample.label_next_open_return == pytest.approx(0.2)
    assert sample.decision_ts == dt.datetime(2024, 1, 3, 9, 25) and sample.news_count == 1 and sample.market_news_count == 1
    assert out.news.first().matched_stock_codes == "600000.SH"
    paths = st.save(out, str(tmp_path / "out"))
    assert spark.read.parquet(paths["panel"]).count() == 3
    assert {r.table_name: r.rows for r in st.run_summary(out).collect()}["samples"] == 1


def test_json_forms_and_path_dates(spark, tmp_path):
    whole = write(tmp_path / "a.json", '[{"x": 1}, {"x": 2}]')
    held = write(tmp_path / "b.json", '{"code": 0,\n "data": [{"x": 3}]}')
    lines = write(tmp_path / "c.jsonl", '{"x": 4}\n{"x": 5}\n')
    assert [[r.x for r in rd.read_table(spark, p).orderBy("x").collect()] for p in (whole, held, lines)] == [[1, 2], [3], [4, 5]]
    assert rd.read_delimited(spark, write(tmp_path / "empty.csv", "")) is None
    paths = [("d/20240105.csv",), ("d/2024-13-40/2024-01-06.csv",), ("d/120240105.csv",), ("d/01-07.csv",), ("none",)]
    got = [r[0] for r in spark.createDataFrame(paths, "p string").select(rd.path_date("p", 2024)).collect()]
    assert got == [D(2024, 1, 5), D(2024, 1, 6), None, D(2024, 1, 7), None]


def test_block_is_replaced_as_a_whole(spark, tmp_path, price):
    path = str(tmp_path / "blocks/one")
    row = sk.write_block(price, path, ["close"])
    assert row["row_count"] == 4 and sk.block_is_complete(spark, path, 4, ["close"], ("stock_code", "trade_date"))
    with pytest.raises(ValueError):
        sk.write_block(price.union(price), path, ["close"])
    assert spark.read.parquet(path).count() == 4
    sk.write_block(price.limit(2), path, ["close", "open"])
    assert not sk.block_is_complete(spark, path, 4, ["close"], ("stock_code", "trade_date"))


def test_scan_range_reaches_the_files(spark, tmp_path, price):
    path = str(tmp_path / "price")
    price.write.parquet(path)
    out = rd.scan_range(spark, path, "trade_date", D(2024, 1, 2), D(2024, 1, 3), ["stock_code", "trade_date", "close"])
    assert out.count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(trade_date" in plan and "open" not in plan


def test_feed_reads_each_file_once(spark, tmp_path):
    folder, target, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    write(folder / "2024-01-01.csv", "code,close\nA,1\n")
    write(folder / "2023-01-01.csv", "code,close\nA,9\n")
    def run():
        feed = new_daily_rows(spark, str(folder), "code string, close double", start="2024-01-01")
        append_new_files(feed, target, mark).awaitTermination(60)

    run()
    write(folder / "2024-01-02.csv", "code,close\nA,2\n")
    run()
    run()
    assert [r.close for r in spark.read.parquet(target).orderBy("close").collect()] == [1.0, 2.0]


def test_names_without_a_score_rank_last(spark):
    data = [(D(2024, 1, 2), c, s) for c, s in (("A", 0.9), ("B", None), ("C", 0.1))]
    df = spark.createDataFrame(data, "target_trade_date date, stock_code string, y_score double")
    got = {r.stock_code: (r["rank"], r.suggested_action) for r in po.trade_signals(df, None, 3, 1).collect()}
    assert got == {"A": (1, "buy"), "C": (2, "buy"), "B": (3, "buy")}
    held = spark.createDataFrame([("B",), ("C",)], "stock_code string")
    got = {r.stock_code: r.suggested_action for r in po.trade_signals(df, held, 2, 1).collect()}
    assert got == {"A": "buy", "C": "sell", "B": "hold"}


def test_quoted_line_breaks_stay_in_one_row(spark, tmp_path):
    for i, sep in enumerate(";,"):
        write(tmp_path / f"daily_{i}.csv", f'id{sep}text\n1{sep}"two\nlines{sep} and ""quotes"""\n2{sep}plain\n')
    paths = rd.find_files(spark, str(tmp_path), ("daily",))
    got = sorted((r.id, r.text) for r in rd.load_many(spark, paths).collect())
    assert got == [("1", 'two\nlines, and "quotes"'), ("1", 'two\nlines; and "quotes"'), ("2", "plain"), ("2", "plain")]


def test_the_last_line_wins_in_files_of_many_blocks(spark, tmp_path):
    """Lines of several files, each read in many blocks: the last line of a day in the last file is kept, whatever it holds."""
    rng = random.Random(4)
    last = {}
    for i in range(3):
        lines = ["ts_code,trade_date,close,vol"]
        for _ in range(3000):
            code, day, close = f"{rng.randint(1, 60):06d}.SZ", f"202401{rng.randint(1, 28):02d}", rng.randint(1, 10**6)
            lines.append(f"{code},{day},{close},1")
            last[code, day] = float(close)
        write(tmp_path / f"daily_{i}.csv", "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        paths = [str(tmp_path / f"daily_{i}.csv") for i in (2, 0, 1)]
        raw = rd.load_many(spark, paths, multi_line=False, places=True)
        assert raw.rdd.getNumPartitions() > 10
        got = {(r.stock_code, r.trade_date.strftime("%Y%m%d")): r.close for r in st.prepare_flow(raw).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == last


def test_times_are_read_from_all_forms(spark):
    forms = ["20240105", "20240105093000", "2024-1-5 9:30", "2024/01/05 09:30:00", "2024.1.5", "1/5/2024", " 2024-01-05T09:30 ", "2024", "x", "20241", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(forms)], "i int, t string")
    got = [str(r.v) if r.v else None for r in df.select("i", parse_time("t").alias("v")).orderBy("i").collect()]
    day, half = "2024-01-05 00:00:00", "2024-01-05 09:30:00"
    assert got == [day, half, half, half, day, day, half, None, None, None, None]


def test_lookback_passes_are_dealt_out_by_the_size_of_the_stored_input(spark, tmp_path, monkeypatch):
    from tidepanel import scale
    from tidepanel.operators.joins import lookback_arrays

    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int"))
    stored = spark.range(2000).select((F.col("id") / 50).cast("int").cast("string").alias("stock_code"), day.alias("trade_date"), F.col("id").cast("double").alias("x"))
    stored.write.parquet(str(tmp_path / "panel"))
    panel = spark.read.parquet(str(tmp_path / "panel"))
    samples = panel.select(F.concat_ws("_", "stock_code", "trade_date").alias("sample_id"), "stock_code", F.col("trade_date").alias("feature_asof_date"))
    monkeypatch.setattr(scale, "TASK_BYTES", 256)
    out = lookback_arrays(panel, samples, ["x"], 3)
    dealt = [int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", out._jdf.queryExecution().toString())]
    assert len(dealt) >= 2 and min(dealt) > 4 * spark.sparkContext.defaultParallelism
    got = out.where((F.col("stock_code") == "3") & (F.col("feature_asof_date") == "2024-01-02")).first()
    assert (got.window_rows, got.x, got.x_mask) == (2, [0.0, 150.0, 151.0], [False, True, True])
