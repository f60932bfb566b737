import datetime as dt
import hashlib
import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidepanel.functions.text import norm_code, norm_name, parse_time, to_half_width
from tidepanel.operators.events import SlotMeasures, windowed_events
from tidepanel.plans import event_scores as es
from tidepanel.plans import news as nw
from tidepanel.plans.news_factors import keyword_coverage, news_factors, scored_items

EVENT_SCHEMA = "news_id string, stock_code string, publish_time timestamp_ntz, v double"
SAMPLE_SCHEMA = "sample_id string, stock_code string, decision_ts timestamp_ntz"


def at(day, hour=9, minute=25, second=0, micro=0):
    return dt.datetime(2024, 1, day, hour, minute, second, micro)


def brute(samples, events, days):
    out = {}
    for sid, code, decision in samples:
        lower = decision - dt.timedelta(days=days)
        seen = [(t, i, v) for i, c, t, v in events if c == code and lower < t <= decision]
        last = max(seen)[2] if seen else None
        out[sid] = (float(len(seen)), pytest.approx(sum(v for _, _, v in seen)) if seen else None, last)
    return out


@pytest.mark.parametrize("clock_count", [1, 3, 40])
def test_windows_against_brute_force(spark, clock_count):
    rng = random.Random(clock_count)
    clocks = [dt.timedelta(minutes=565 + 7 * i) for i in range(clock_count)]
    start = dt.datetime(2024, 1, 1)
    samples = [
        (f"{c}{d}", c, start + dt.timedelta(days=d) + rng.choice(clocks)) for c in "AB" for d in range(2, 25)
    ]
    events = [
        (f"n{i}", rng.choice("ABC"), start + dt.timedelta(seconds=rng.randrange(25 * 86400)), rng.random()) for i in range(200)
    ]
    # exactly on both ends of a window
    sid, code, decision = samples[5]
    events += [("on", code, decision, 5.0), ("off", code, decision - dt.timedelta(days=3), 7.0)]
    measures = SlotMeasures(sums={"total": F.col("v")}, latest=("v",))
    out = windowed_events(
        spark.createDataFrame(samples, SAMPLE_SCHEMA), spark.createDataFrame(events, EVENT_SCHEMA), [1, 3], measures, "stock_code"
    )
    for days in (1, 3):
        got = {r["sample_id"]: (r[f"count_{days}d"], r[f"total_{days}d"], r[f"latest_v_{days}d"]) for r in out.collect()}
        assert got == brute(samples, events, days)


def plan_nodes(df):
    """Names of the plan's nodes, in order."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return [line.lstrip(" :+-").split(" ")[0].split("(")[0] for line in text.splitlines()]


def test_any_decision_times_by_one_plan(spark):
    """Times to the microsecond, many in one minute, and one entity with most events in a single minute; the plan is that of one clock."""
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    when = lambda days: start + dt.timedelta(microseconds=rng.randrange(days * 86_400_000_000))
    busy = [start + dt.timedelta(days=6, hours=9, microseconds=rng.randrange(60_000_000)) for _ in range(60)]
    samples = [(f"s{i}", rng.choice("AB"), when(9)) for i in range(40)] + [(f"b{i}", "A", t) for i, t in enumerate(busy)]
    samples += [("again", "A", busy[0]), ("lonely", "Z", busy[0])]
    events = [(f"n{i}", rng.choice("AB"), when(9), rng.random()) for i in range(300)]
    events += [(f"m{i}", "A", t - dt.timedelta(days=rng.choice([0, 1, 4])), rng.random()) for i, t in enumerate(busy * 3)]
    events += [(f"d{i}", "A", start + dt.timedelta(days=5), 0.5) for i in range(50)]
    measures = SlotMeasures(sums={"total": F.col("v")}, maxima={"high": F.col("v")}, minima={"low": F.col("v")}, latest=("v",))
    run = lambda rows: windowed_events(
        spark.createDataFrame(rows, SAMPLE_SCHEMA), spark.createDataFrame(events, EVENT_SCHEMA), [1, 4], measures, "stock_code"
    )
    out = run(samples).collect()
    assert len(out) == len(samples)
    for days in (1, 4):
        got = {r["sample_id"]: (r[f"count_{days}d"], r[f"total_{days}d"], r[f"latest_v_{days}d"]) for r in out}
        assert got == brute(samples, events, days)
        for r in out:
            code, decision = next((c, t) for s, c, t in samples if s == r["sample_id"])
            seen = [v for _, c, t, v in events if c == code and decision - dt.timedelta(days=days) < t <= decision]
            assert (r[f"high_{days}d"], r[f"low_{days}d"]) == ((max(seen), min(seen)) if seen else (None, None))
    one_clock = [(s, c, t.replace(hour=9, minute=25, second=0, microsecond=0)) for s, c, t in samples]
    assert plan_nodes(run(one_clock)) == plan_nodes(run(samples))


def test_news_factors_open_below_closed_above(spark):
    samples = spark.createDataFrame([("A_2024-01-03", "A", at(3))], SAMPLE_SCHEMA)
    items = spark.createDataFrame(
        [("n1", "h1", at(2), 0), ("n2", "h2", at(2, 9, 25, 0, 1), 0), ("n3", "h3", at(3), 0), ("n4", "h3", at(3, 9, 25, 1), 0)],
        "news_id string, news_text_hash string, publish_time timestamp_ntz, matched_stock_count int",
    )
    scores = spark.createDataFrame(
        [("h1", 0.9, 0.9, 0.1, 1.0, 0.5, "policy"), ("h2", -0.5, 0.5, 0.2, 0.5, 0.5, None), ("h3", 0.5, 0.8, 0.4, 0.5, 0.1, "macro")],
        "news_text_hash string, sentiment_score double, impact_score double, risk_score double, relevance_score double, "
        "novelty_score double, event_type string",
    )
    table = news_factors(samples, scored_items(items, scores, ["news_text_hash"]), "market", windows=(1, 3))
    row = table.df.first()
    assert row["news_market_count_1d"] == 2.0 and row["news_market_count_3d"] == 3.0
    assert row["news_market_negative_high_impact_count_1d"] == 1.0 and row["news_market_high_impact_count_1d"] == 1.0
    assert row["news_market_sentiment_mean_1d"] == pytest.approx(0.0)
    assert row["news_market_impact_weighted_sentiment_1d"] == pytest.approx((-0.25 + 0.4) / 1.3)
    assert row["news_market_latest_sentiment_1d"] == 0.5 and row["news_market_hours_since_latest_1d"] == 0.0
    assert row["news_market_policy_count_1d"] == 0.0 and row["news_market_macro_count_1d"] == 1.0
    assert len(table.names) == 2 * (17 + 6)


def test_no_events_gives_zero_counts_and_missing_values(spark):
    samples = spark.createDataFrame([("A", "A", at(3))], SAMPLE_SCHEMA)
    empty = spark.createDataFrame([], "news_id string, publish_time timestamp_ntz, matched_stock_count int, event_type string, "
                                  + ", ".join(f"{c} double" for c in es.SCORE_COLUMNS))
    row = news_factors(samples, empty, "market", windows=(1,)).df.first()
    assert row["news_market_count_1d"] == 0.0 and row["news_market_policy_count_1d"] == 0.0
    assert row["news_market_sentiment_mean_1d"] is None


def test_codes_names_and_times(spark):
    data = [("600000.sh",), ("sz000001",), (" １２３４５６.SZ",), ("abc",), ("  ",), (None,), ("x1234567",)]
    df = spark.createDataFrame(data, "c string")
    assert [r[0] for r in df.select(norm_code("c")).collect()] == [
        "600000.SH", "000001", "１２３４５６.SZ", "abc", None, None, "234567"
    ]
    names = spark.createDataFrame([("　浦 发\t银行 ",), ("",)], "c string")
    assert [r[0] for r in names.select(norm_name("c")).collect()] == ["浦发银行", None]
    assert spark.range(1).select(to_half_width(F.lit("ＡＢ１ｚ"))).first()[0] == "AB1z"
    times = spark.createDataFrame(
        [("20240105093000",), ("20240105",), ("2024/1/5",), ("2024-01-05 09:30",), ("2024-01-05T09:30:00+08:00",), ("20241305",), ("soon",), ("2024",)],
        "c string",
    )
    day = dt.datetime(2024, 1, 5)
    half = dt.datetime(2024, 1, 5, 9, 30)
    assert [r[0] for r in times.select(parse_time("c")).collect()] == [half, day, day, half, half, None, None, None]


def test_matching_is_longest_first_without_overlap(spark):
    names = spark.createDataFrame(
        [("000001.SZ", "平安银行"), ("600000.SH", "平安银行浦东"), ("300001.SZ", "ＡＢＣ股份"), ("600009.SH", "浦东机场")],
        "stock_code string, stock_name string",
    )
    raw = spark.createDataFrame(
        [
            ("平安银行浦东机场", "600009 和 6000091 与 000001.SZ", None),
            ("ABC股份 平安银行", "无", "600009.sh"),
            ("空", "无", None),
        ],
        "title string, content string, stock_code string",
    )
    out = nw.match_stocks(nw.compose_text(raw), names)
    got = {r.title: r.matched_stock_codes for r in out.collect()}
    assert got == {
        "平安银行浦东机场": "600009.SH|000001.SZ|600000.SH",
        "ABC股份 平安银行": "600009.SH|300001.SZ|000001.SZ",
        "空": "",
    }


def join_rows(df):
    """Rows that each join of the executed plan gave."""
    df.collect()
    found, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            nodes.append(node.executedPlan())
        elif "QueryStage" in name:
            nodes.append(node.plan())
        if "Join" in name:
            found.append(node.metrics().apply("numOutputRows").value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_names_that_begin_alike_are_met_by_equality(spark):
    names = [(f"{i:06d}.SZ", f"Sup{i:04d}") for i in range(400)] + [("900000.SH", "Sup0007 Holding"), ("900001.SH", "Sup")]
    aliases = nw.alias_table(spark.createDataFrame(names, "stock_code string, stock_name string"))
    titles = [(i, f"On Sup{i:04d} and Sup9999") for i in range(300)] + [(900, "Sup0007Holding, Sup0007"), (901, "Su"), (902, None)]
    out = nw.names_in_text(spark.createDataFrame(titles, "id int, title string"), aliases, "id", "title")
    # each title: a listed name and the short one; the longest at a place counts
    assert rows(out.where("id in (3, 900, 901, 902)"), "id", "place") == [
        (3, 4, "000003.SZ"), (3, 16, "900001.SH"), (900, 1, "900000.SH"), (900, 17, "000007.SZ"),
    ]
    assert max(join_rows(out)) < 10 * len(titles)


def test_items_and_map_read_the_matched_news_once(spark):
    data = [(at(1), "a 000001", "000001.SZ", "000001.SZ"), (at(2), "b", "", None)]
    detail = spark.createDataFrame(data, "publish_time timestamp_ntz, news_text string, matched_stock_codes string, stock_code string")
    items, pairs = nw.news_items(detail.dropDuplicates())
    assert items.inputFiles() and set(items.inputFiles()) == set(pairs.inputFiles())
    assert (items.count(), pairs.count()) == (2, 1)


def test_news_ids_and_map(spark):
    schema = "publish_time timestamp_ntz, trade_date date, news_text string, matched_stock_codes string, stock_code string, __source_file string"
    data = [
        (at(1, 8, 0), dt.date(2024, 1, 2), " a \n b ", "000001.SZ|600000SH", "000001.SZ", "f2"),
        (at(1, 8, 0), dt.date(2024, 1, 2), "a b", "bad,300001", None, "f1"),
        (at(1, 8, 0, 0, 5), dt.date(2024, 1, 2), "a b", "", None, "f1"),
        (None, None, "lost", "", None, "f1"),
        (at(2), None, "  ", "", None, "f1"),
    ]
    items, pairs = nw.news_items(spark.createDataFrame(data, schema))
    text = hashlib.sha256(b"a b").hexdigest()
    ids = [hashlib.sha256(f"{t}\n{text}".encode()).hexdigest() for t in ("2024-01-01T08:00:00", "2024-01-01T08:00:00.000005")]
    got = {r.news_id: (r.source_file, r.matched_stock_codes, r.matched_stock_count) for r in items.collect()}
    assert got.keys() == set(ids) and got[ids[1]] == ("f1", "", 0)
    assert set(got[ids[0]][1].split("|")) == {"000001.SZ", "600000.SH", "300001"} and got[ids[0]][0] == "f1"
    assert pairs.count() == 3
    nw.check_items(items, pairs)
    with pytest.raises(ValueError, match="unknown news ids"):
        nw.check_items(items.where(F.col("matched_stock_count") == 0), pairs)


def test_long_days_are_joined_in_parts(spark):
    data = [(dt.date(2024, 1, 1), at(1, 9, 0, i), f"t{i:02d}") for i in range(7)] + [(dt.date(2024, 1, 2), at(2), "x")]
    df = spark.createDataFrame(data + data[:2], "trade_date date, publish_time timestamp_ntz, news_text string")
    # three texts of three bytes begin within the first nine bytes
    out = rows(nw.joined_texts(df, ["trade_date"], "text", part_bytes=9), "trade_date", "part")
    order = [t for _, _, t in data[:7]]
    assert out == [
        (dt.date(2024, 1, 1), 0, "\n\n".join(order[:3])),
        (dt.date(2024, 1, 1), 1, "\n\n".join(order[3:6])),
        (dt.date(2024, 1, 1), 2, order[6]),
        (dt.date(2024, 1, 2), 0, "x"),
    ]


def test_daily_digests_cover_all_parts(spark):
    texts = [f"t{i:02d}é" for i in range(7)]
    day, empty = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    data = [(code, day, at(1, 9, 0, i), t) for code in ("a", "b") for i, t in enumerate(texts[: 7 if code == "a" else 1])]
    df = spark.createDataFrame(data, "stock_code string, trade_date date, publish_time timestamp_ntz, news_text string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def tree(leaves, fan):
        nodes = [",".join(sha(t) for t in leaves[i : i + fan]) for i in range(0, len(leaves), fan)]
        return sha(",".join(sha(n) for n in nodes))

    stock = nw.stock_daily(df, part_bytes=8, fan=3)
    found = [(r.stock_code, r.news_count, r.news_text_sha256, r.text_parts) for r in stock.orderBy("stock_code").collect()]
    assert found == [("a", 7, tree(texts, 3), 4), ("b", 1, tree(texts[:1], 3), 1)]
    own = df.where("stock_code = 'a'")
    market = nw.market_daily(own, spark.createDataFrame([(day,), (empty,)], "d date"), part_bytes=8)
    found = [(r.market_news_text_sha256, r.market_text_parts) for r in market.orderBy("trade_date").collect()]
    assert found == [(tree(texts, 1024), 4), (sha(""), 0)]
    parts = nw.joined_texts(df, ["stock_code", "trade_date"], nw.STOCK_TEXT, part_bytes=8)
    assert "\n\n".join(nw.text_of(parts, nw.STOCK_TEXT, stock_code="a", trade_date=day)) == "\n\n".join(texts)


def test_bad_answers_are_rejected_with_a_reason(spark):
    good = '{"sentiment_score": "-0.5", "impact_score": 1, "risk_score": 0, "relevance_score": 0.2, "novelty_score": 0.1, "event_type": "Geo politics"}'
    data = [(1, good), (2, good.replace('"impact_score": 1,', '"impact_score": 1.5,')), (3, "no json"), (4, f"text {good} more")]
    out = es.read_answers(spark.createDataFrame(data, "id int, payload string"))
    got = {r.id: (r.sentiment_score, r.event_type, r.horizon, r.reject_reason) for r in out.collect()}
    assert got[1] == (-0.5, "other", "unknown", None) and got[4] == got[1]
    assert got[2][3] == "impact_score"
    assert got[3][3] == ";".join(es.SCORE_COLUMNS)


def test_keyword_groups_count_each_news_once_per_group(spark):
    data = [(dt.date(2025, 2, 1), 1, "AI 芯片"), (dt.date(2024, 2, 1), 0, "AIR 存储 半导体"), (dt.date(2023, 2, 1), 0, "PCB")]
    df = spark.createDataFrame(data, "trade_date date, matched_stock_count int, news_text string")
    got = {(r.theme_keyword_group, r.since): (r.total_news, r.stock_news, r.market_news) for r in keyword_coverage(df).collect()}
    assert got["ai_compute", "2024-01-01"] == (1, 1, 0) and got["pcb", "2024-01-01"] == (0, 0, 0)
    assert got["semiconductor", "2024-01-01"] == (2, 1, 1) and got["semiconductor", "2025-01-01"] == (1, 1, 0)
    assert len(got) == 18


def test_event_windows_are_dealt_out_by_the_size_of_the_stored_input(spark, tmp_path, monkeypatch):
    from tidepanel import scale

    start = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    stored = spark.range(2000).select(
        F.col("id").alias("news_id"), (F.col("id") % 40).cast("string").alias("stock_code"),
        (start + F.make_dt_interval(mins=(F.col("id") * 7).cast("int"))).alias("publish_time"),
    )
    stored.write.parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    samples = events.select(F.col("news_id").alias("sample_id"), "stock_code", F.col("publish_time").alias("decision_ts"))
    monkeypatch.setattr(scale, "TASK_BYTES", 512)
    out = windowed_events(samples, events, (1, 3), SlotMeasures(), "stock_code")
    dealt = [int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", out._jdf.queryExecution().toString())]
    assert len(dealt) >= 4 and min(dealt) > 4 * spark.sparkContext.defaultParallelism
    # every 280 minutes an event of the stock: 5 or 6 within a day
    assert out.where("sample_id = 1999").first().count_1d == 6.0


def test_news_are_matched_dated_and_compared_without_their_texts(spark):
    days = [dt.date(2024, 1, d) for d in (2, 3)]
    price = spark.createDataFrame([(c, n, d) for c, n in (("000001.SZ", "alpha"), ("600000.SH", "beta1")) for d in days],
                                  "stock_code string, stock_name string, trade_date date")
    data = [
        ("20240102080000", "alpha and beta1", "long", None, "f1"), ("20240102080000", "alpha and beta1", "long", None, "f2"),
        ("20240102090000", "beta1", "000001 x", None, "f1"), ("20240102160000", "none", "", " 600000.sh", "f1"),
        ("20240103160000", "alpha", "too late", None, "f1"), ("20240102080000", "alpha", "first", None, "f1"),
    ]
    raw = spark.createDataFrame(data, "datetime string, title string, content string, code string, __source_file string")
    news = nw.stored_news(raw)
    detail = nw.prepare_news(news, price)
    whole = lambda df: {(r.trade_date.day, r.publish_time.hour, r.news_text, r.matched_stock_codes, r["__source_file"]) for r in df.collect()}
    expected = {
        (2, 8, "alpha and beta1\nlong", "000001.SZ|600000.SH", "f2"), (2, 8, "alpha\nfirst", "000001.SZ", "f1"),
        (2, 9, "beta1\n000001 x", "000001.SZ|600000.SH", "f1"), (3, 16, "none\n", "600000.SH", "f1"),
    }
    assert whole(detail) == whole(nw.prepare_news(raw, price)) == expected and detail.count() == 4
    rows_ = nw.stock_rows(detail)
    keys = ["stock_code", "trade_date"]
    plan = nw._slim(rows_, keys)._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert len(read) == 2 and "content#" not in "".join(read) and "title#" not in "".join(read)
    told = {(r.stock_code, r.trade_date, r.part): r.text for r in nw.joined_texts(rows_, keys, "text", texts=news).collect()}
    plain = rows_.drop(*nw.MARKS)
    assert told == {(r.stock_code, r.trade_date, r.part): r.text for r in nw.joined_texts(plain, keys, "text").collect()}
    first = sorted(["alpha and beta1\nlong", "alpha\nfirst"], key=lambda x: hashlib.sha256(x.encode()).hexdigest())
    assert told["000001.SZ", days[0], 0] == "\n\n".join([*first, "beta1\n000001 x"]) and len(told) == 3
    assert nw.stock_daily(rows_).drop("sample_id").orderBy(*keys).collect() == nw.stock_daily(plain).drop("sample_id").orderBy(*keys).collect()


def test_places_are_not_shuffled_for_few_heads(spark):
    aliases = spark.createDataFrame([("alpha", "1"), ("alphabet", "2"), ("beta", "3")], "alias string, stock_code string")
    texts = spark.createDataFrame([(1, "an alphabet of beta"), (2, "alpha")], "_key int, title_text string")
    out = nw.names_in_text(texts, aliases)
    assert rows(out.drop("place"), "_key", "stock_code") == [(1, "2"), (1, "3"), (2, "1")]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"BroadcastHashJoin \[head#", plan)
