"""Factor families over the monthly panel, and their catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import cross_section as cs
from tidepanel.plans import flow_factors as ff
from tidepanel.plans import price_factors as pf
from tidepanel.plans import value_factors as vf
from tidepanel.plans.candidates import ROW_FUNCTIONS, WINDOW_FUNCTIONS
from tidepanel.plans.factor_table import NeutralForms, append_neutral, catalog, combine, missing_rates
from tidepanel.registry import tables
from tidepanel.registry.base import query, rounded, tidy
from tidepanel.registry.q_cross_section import DAY, avg_rank
from tidepanel.registry.q_timeseries import ENTITY, _corr, _line, gate, rolling
from tidepanel.plans.catalogue import BLOCK_SCHEMA, block_problems, describe_block, feature_group, feature_modality, present_values
from tidepanel.registry.tables import sql
from tidepanel.scale import stage_path
from tidepanel.sources import sinks as sk

NO_FAMILY = {"kbar": False, "relative": False, "return_windows": (), "rolling_windows": ()}
P = pf.PREFIX
EPS = "1e-12"

KBAR_SQL = {
    "KMID": "(close - open) / nullif(open, 0)",
    "KLEN": "(high - low) / nullif(open, 0)",
    "KMID2": f"(close - open) / (high - low + {EPS})",
    "KUP": "(high - greatest(open, close)) / nullif(open, 0)",
    "KUP2": f"(high - greatest(open, close)) / (high - low + {EPS})",
    "KLOW": "(least(open, close) - low) / nullif(open, 0)",
    "KLOW2": f"(least(open, close) - low) / (high - low + {EPS})",
    "KSFT": "(2 * close - high - low) / nullif(open, 0)",
    "KSFT2": f"(2 * close - high - low) / (high - low + {EPS})",
}
# One bar has equal high and low; the quotient over eps is then exactly zero on both sides.


@query(
    "price_candlestick",
    sql(
        "price",
        f"SELECT stock_code, trade_date, {rounded([P + n for n in KBAR_SQL])} FROM (SELECT *, "
        + ", ".join(f"{e} AS {P}{n}" for n, e in KBAR_SQL.items())
        + " FROM price)",
    ),
)
def price_candlestick(spark, sf):
    """Nine candlestick factors."""
    return tidy(pf.price_factors(tables.price(spark, sf), **{**NO_FAMILY, "kbar": True}).output())


_RELATIVE = {
    f"{P}{f.upper()}{k}": f"{f} / close" if k == 0 else f"lag({f}, {k}) OVER ({ENTITY}) / close"
    for f in pf.PRICE_FIELDS
    for k in pf.PRICE_DELAYS
}


@query(
    "price_relative",
    sql(
        "price",
        f"SELECT stock_code, trade_date, {rounded(list(_RELATIVE))} FROM (SELECT *, "
        + ", ".join(f"{e} AS {n}" for n, e in _RELATIVE.items())
        + " FROM price)",
    ),
)
def price_relative(spark, sf):
    """Sixteen prices relative to the close."""
    return tidy(pf.price_factors(tables.price(spark, sf), **{**NO_FAMILY, "relative": True}).output())


_RETURN = {f"{P}ROC{w}": f"lag(close, {w}) OVER ({ENTITY}) / close" for w in pf.RETURN_WINDOWS}


@query(
    "price_return",
    sql(
        "price",
        f"SELECT stock_code, trade_date, {rounded(list(_RETURN))} FROM (SELECT *, "
        + ", ".join(f"{e} AS {n}" for n, e in _RETURN.items())
        + " FROM price)",
    ),
)
def price_return(spark, sf):
    """Six earlier closes relative to the close."""
    table = pf.price_factors(tables.price(spark, sf), **{**NO_FAMILY, "return_windows": pf.RETURN_WINDOWS})
    return tidy(table.output())


STEPS_SQL = f"""lagged AS (SELECT *, row_number() OVER ({ENTITY}) AS pos, lag(close) OVER ({ENTITY}) AS c1,
  lag(volume) OVER ({ENTITY}) AS v1 FROM holes),
steps AS (SELECT *, ln(volume + 1) AS log_volume, close / nullif(c1, 0) AS close_ratio,
  CASE WHEN c1 IS NOT NULL THEN ln(volume / nullif(v1, 0) + 1) END AS log_volume_ratio,
  abs(close - c1) AS move, CASE WHEN close - c1 IS NOT NULL THEN greatest(close - c1, 0) END AS up,
  CASE WHEN close - c1 IS NOT NULL THEN greatest(c1 - close, 0) END AS down,
  CASE WHEN c1 IS NOT NULL THEN CASE WHEN close > c1 THEN 1 ELSE 0 END END AS up_day,
  CASE WHEN c1 IS NOT NULL THEN CASE WHEN close < c1 THEN 1 ELSE 0 END END AS down_day,
  abs(volume - v1) AS flow, CASE WHEN volume - v1 IS NOT NULL THEN greatest(volume - v1, 0) END AS volume_up,
  CASE WHEN volume - v1 IS NOT NULL THEN greatest(v1 - volume, 0) END AS volume_down,
  CASE WHEN c1 IS NOT NULL THEN abs(close / nullif(c1, 0) - 1) * volume END AS swing FROM lagged)"""
HOLES_SQL = (
    "holes AS (SELECT * REPLACE (CASE WHEN (k * 31 + mno * 17) % 97 <> 0 THEN close END AS close, "
    "CASE WHEN (k * 13 + mno * 7) % 89 <> 0 THEN volume END AS volume) FROM price)"
)


def holes(spark, sf) -> DataFrame:
    """Price with a few missing closes and volumes."""
    k, m = F.col("k"), F.col("mno")
    return tables.price(spark, sf).withColumns(
        {
            "close": F.when((k * 31 + m * 17) % 97 != 0, F.col("close")),
            "volume": F.when((k * 13 + m * 7) % 89 != 0, F.col("volume")),
        }
    )


def rolling_sql(w: int) -> dict[str, str]:
    def agg(fn: str, x: str) -> str:
        return gate(x, w, f"{fn}({x}) OVER {rolling(w)}")

    def place(fn: str, x: str) -> str:
        return gate(x, w, f"list_position(list({x}) OVER {rolling(w)}, {fn}({x}) OVER {rolling(w)})") + "::DOUBLE"

    window = f"list(close) OVER {rolling(w)}"
    rank = gate("close", w, f"CASE WHEN close IS NOT NULL THEN (len(list_filter({window}, lambda v: v < close)) + "
                f"(len(list_filter({window}, lambda v: v = close)) + 1) / 2.0) / count(close) OVER {rolling(w)} END")
    top, bottom = agg("max", "high"), agg("min", "low")
    up, down, moves = agg("sum", "up"), agg("sum", "down"), f"({agg('sum', 'move')} + {EPS})"
    v_up, v_down, flows = agg("sum", "volume_up"), agg("sum", "volume_down"), f"({agg('sum', 'flow')} + {EPS})"
    rows = {
        "MA": f"{agg('avg', 'close')} / close",
        "STD": f"{agg('stddev_samp', 'close')} / close",
        "BETA": f"{_line('close', w, 'slope')} / close",
        "RSQR": _line("close", w, "r2"),
        "RESI": f"{_line('close', w, 'residual')} / close",
        "MAX": f"{top} / close",
        "MIN": f"{bottom} / close",
        "QTLU": gate("close", w, f"quantile_cont(close, 0.8) OVER {rolling(w)}") + " / close",
        "QTLD": gate("close", w, f"quantile_cont(close, 0.2) OVER {rolling(w)}") + " / close",
        "RANK": rank,
        "RSV": f"(close - {bottom}) / ({top} - {bottom} + {EPS})",
        "IMAX": f"{place('max', 'high')} / {w}",
        "IMIN": f"{place('min', 'low')} / {w}",
        "IMXD": f"({place('max', 'high')} - {place('min', 'low')}) / {w}",
        "CORR": _corr("close", "log_volume", w, w),
        "CORD": _corr("close_ratio", "log_volume_ratio", w, w),
        "CNTP": agg("avg", "up_day"),
        "CNTN": agg("avg", "down_day"),
        "CNTD": f"{agg('avg', 'up_day')} - {agg('avg', 'down_day')}",
        "SUMP": f"{up} / {moves}",
        "SUMN": f"{down} / {moves}",
        "SUMD": f"({up} - {down}) / {moves}",
        "VMA": f"{agg('avg', 'volume')} / (volume + {EPS})",
        "VSTD": f"{agg('stddev_samp', 'volume')} / (volume + {EPS})",
        "WVMA": f"{agg('stddev_samp', 'swing')} / ({agg('avg', 'swing')} + {EPS})",
        "VSUMP": f"{v_up} / {flows}",
        "VSUMN": f"{v_down} / {flows}",
        "VSUMD": f"({v_up} - {v_down}) / {flows}",
    }
    return {f"{P}{name}{w}": text for name, text in rows.items()}


def _register_rolling(w: int) -> None:
    columns = rolling_sql(w)
    oracle = sql(
        "price",
        f"SELECT stock_code, trade_date, {rounded(list(columns))} FROM (SELECT *, "
        + ", ".join(f"{e} AS {n}" for n, e in columns.items())
        + " FROM steps)",
        HOLES_SQL,
        STEPS_SQL,
    )

    @query(f"price_rolling{w}", oracle)
    def run(spark, sf):
        return tidy(pf.price_factors(holes(spark, sf), **{**NO_FAMILY, "rolling_windows": (w,)}).output())


for _w in pf.ROLLING_WINDOWS:
    _register_rolling(_w)


# -- neutral forms ---------------------------------------------------------------


def neutral_sql(names: list[str]) -> dict[str, str]:
    out = {}
    for n in names:
        out[f"{n}_cs_pct"] = f"({avg_rank(n)}) / nullif(count({n}) OVER ({DAY}), 0)"
        out[f"{n}_cs_z"] = f"({n} - avg({n}) OVER ({DAY})) / nullif(stddev_pop({n}) OVER ({DAY}), 0)"
        out[f"{n}_ind_neu"] = (
            f"CASE WHEN trim(industry) <> '' THEN {n} - avg({n}) OVER (PARTITION BY trade_date, industry) END"
        )
    return out


_KBAR = [P + n for n in KBAR_SQL]
_KBAR_NEUTRAL = neutral_sql(_KBAR)


@query(
    "neutral_expansion",
    sql(
        "price",
        f"SELECT stock_code, trade_date, {rounded([*_KBAR, *_KBAR_NEUTRAL])} FROM (SELECT *, "
        + ", ".join(f"{e} AS {n}" for n, e in _KBAR_NEUTRAL.items())
        + " FROM base)",
        "base AS (SELECT stock_code, trade_date, industry, "
        + ", ".join(f"{e} AS {P}{n}" for n, e in KBAR_SQL.items())
        + " FROM price)",
    ),
)
def neutral_expansion(spark, sf):
    """Candlestick factors with percentile, z-score and industry-neutral forms."""
    table = pf.price_factors(tables.price(spark, sf), **{**NO_FAMILY, "kbar": True})
    return tidy(append_neutral(table).output())


# -- metric ----------------------------------------------------------------------


def _metric_sql() -> dict[str, str]:
    out = {f"metric_{c}": c for c in vf.RAW_FIELDS}
    out |= {f"metric_{c}_missing": f"CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE" for c in vf.MISSING_FLAG_FIELDS}
    out |= {
        "metric_earnings_yield": "1 / nullif(pe_ttm, 0)",
        "metric_book_to_price": "1 / nullif(pb, 0)",
        "metric_sales_to_price": "1 / nullif(ps_ttm, 0)",
        "metric_log_total_mv": "CASE WHEN total_mv > 0 THEN ln(total_mv) END",
        "metric_log_circ_mv": "CASE WHEN circ_mv > 0 THEN ln(circ_mv) END",
    }
    out |= {f"metric_{c}_delta{w}": f"{c} - lag({c}, {w}) OVER ({ENTITY})" for c in vf.DELTA_FIELDS for w in vf.DELTA_WINDOWS}
    out |= {f"metric_{c}_ma{w}": gate(c, w, f"avg({c}) OVER {rolling(w)}") for c in vf.MEAN_FIELDS for w in vf.MEAN_WINDOWS}
    return out


METRIC_SQL = _metric_sql()
METRIC_BASE = (
    "base AS (SELECT stock_code, trade_date, industry, "
    + ", ".join(f"{e} AS {n}" for n, e in METRIC_SQL.items())
    + " FROM metric)"
)


@query(
    "value_factors",
    sql("metric", f"SELECT stock_code, trade_date, {rounded(list(METRIC_SQL))} FROM base", METRIC_BASE),
)
def value_factors(spark, sf):
    """All 58 valuation, size and turnover factors."""
    return tidy(vf.value_factors(tables.metric(spark, sf)).output())


@query(
    "neutral_eligibility",
    sql(
        "metric",
        "SELECT factor, missing, missing <= 0.25 AS eligible FROM (SELECT factor, round(missing, 6) + 0 AS missing FROM ("
        + " UNION ALL ".join(
            f"SELECT '{n}' AS factor, avg(CASE WHEN {n} IS NULL THEN 1.0 ELSE 0.0 END) AS missing FROM base"
            for n in METRIC_SQL
            if not n.endswith("_missing")
        )
        + "))",
        METRIC_BASE,
    ),
)
def neutral_eligibility(spark, sf):
    """Share of missing values per factor and whether it gets neutral forms."""
    table = vf.value_factors(tables.metric(spark, sf))
    names = [e.name for e in table.entries if e.category != "metric.missing"]
    rates = missing_rates(table.df, names).unpivot([], names, "factor", "missing")
    return tidy(rates.withColumn("eligible", F.col("missing") <= 0.25))


_ELIGIBLE = [n for n in METRIC_SQL if n in ("metric_pb", "metric_turnover_rate", "metric_log_total_mv", "metric_pb_delta1")]


@query(
    "value_factors_neutral",
    sql(
        "metric",
        f"SELECT stock_code, trade_date, {rounded(list(neutral_sql(_ELIGIBLE)))} FROM (SELECT *, "
        + ", ".join(f"{e} AS {n}" for n, e in neutral_sql(_ELIGIBLE).items())
        + " FROM base)",
        METRIC_BASE,
    ),
)
def value_factors_neutral(spark, sf):
    """Neutral forms of some metric factors."""
    table = vf.value_factors(tables.metric(spark, sf))
    out = append_neutral(table, NeutralForms(names=tuple(_ELIGIBLE)))
    return tidy(out.df.select(*out.keys, *neutral_sql(_ELIGIBLE)))


# -- money flow ------------------------------------------------------------------

_RATIOS = {
    "mf_net_amount_ratio": "net_mf_amount",
    "mf_main_net_amount_ratio": "buy_lg_amount + buy_elg_amount - sell_lg_amount - sell_elg_amount",
    "mf_lg_net_amount_ratio": "buy_lg_amount - sell_lg_amount",
    "mf_elg_net_amount_ratio": "buy_elg_amount - sell_elg_amount",
    "mf_lg_amount_ratio": "buy_lg_amount + sell_lg_amount",
    "mf_elg_amount_ratio": "buy_elg_amount + sell_elg_amount",
    "mf_small_order_pressure": "sell_sm_amount - buy_sm_amount",
}


def _flow_sql() -> dict[str, str]:
    out = {n: n for n in _RATIOS}
    main = "mf_main_net_amount_ratio"
    for base in ("mf_net_amount_ratio", main, "mf_small_order_pressure"):
        for w in ff.ROLLING_WINDOWS:
            out[f"{base}_ma{w}"] = gate(base, w, f"avg({base}) OVER {rolling(w)}")
            out[f"{base}_slope{w}"] = _line(base, w, "slope")
    for w in ff.POSITIVE_WINDOWS:
        out[f"mf_main_positive_days{w}"] = gate("inflow", w, f"sum(inflow) OVER {rolling(w)}") + "::DOUBLE"
        out[f"mf_price_flow_confirm{w}"] = gate("agree", w, f"avg(agree) OVER {rolling(w)}")
    for w in ff.CORR_WINDOWS:
        out[f"mf_price_flow_corr{w}"] = _corr("ret", main, w, w)
    return out


FLOW_SQL = _flow_sql()


@query(
    "flow_factors",
    sql(
        "price flow",
        f"SELECT stock_code, trade_date, {rounded(list(FLOW_SQL))} FROM (SELECT stock_code, trade_date, "
        + ", ".join(f"{e} AS {n}" for n, e in FLOW_SQL.items())
        + " FROM marked)",
        "joined AS (SELECT f.*, p.close, p.amount FROM flow f LEFT JOIN price p USING (stock_code, trade_date))",
        f"ratios AS (SELECT *, row_number() OVER ({ENTITY}) AS pos, close / nullif(lag(close) OVER ({ENTITY}), 0) - 1 AS ret, "
        + ", ".join(f"({e}) * 10 / nullif(amount, 0) AS {n}" for n, e in _RATIOS.items())
        + " FROM joined)",
        "marked AS (SELECT *, CASE WHEN mf_main_net_amount_ratio IS NOT NULL THEN (mf_main_net_amount_ratio > 0)::INT END AS inflow, "
        "CASE WHEN mf_main_net_amount_ratio IS NOT NULL AND ret IS NOT NULL THEN (ret > 0 AND mf_main_net_amount_ratio > 0)::INT END AS agree FROM ratios)",
    ),
)
def flow_factors(spark, sf):
    """All 41 money-flow factors."""
    return tidy(ff.flow_factors(tables.flow(spark, sf), tables.price(spark, sf)).output())


# -- candidates, combination, catalog ----------------------------------------------


@query(
    "candidate_functions",
    sql(
        "gappy",
        f"""SELECT stock_code, trade_date, {rounded(['trend', 'swing', 'pull', 'mix', 'rank', 'z', 'neutral'])} FROM (
          SELECT *, ({avg_rank('trend')}) / nullif(count(trend) OVER ({DAY}), 0) AS rank,
            (swing - avg(swing) OVER ({DAY})) / nullif(stddev_pop(swing) OVER ({DAY}), 0) AS z,
            CASE WHEN trim(industry) <> '' THEN pull - avg(pull) OVER (PARTITION BY trade_date, industry) END AS neutral
          FROM (SELECT *, x / nullif(lag(x, 3) OVER ({ENTITY}), 0) - 1 AS trend,
              {gate('x', 5, f'stddev_samp(x) OVER {rolling(5)}')} / nullif({gate('x', 5, f'avg(x) OVER {rolling(5)}')}, 0) AS swing,
              (x - {gate('low', 4, f'min(low) OVER {rolling(4)}')}) / nullif({gate('high', 4, f'max(high) OVER {rolling(4)}')}, 0) AS pull,
              abs(ln(1 + abs(y - lag(y, 2) OVER ({ENTITY}))) * sign(t - 2)) * y AS mix FROM gappy))""",
    ),
)
def candidate_functions(spark, sf):
    """Candidate formulas written with the allowed functions."""
    f = {**ROW_FUNCTIONS, **WINDOW_FUNCTIONS}
    df = tables.gappy(spark, sf).withColumns(
        {
            "trend": f["pct_change"]("x", 3),
            "swing": f["safe_div"](f["rolling_std"]("x", 5), f["rolling_mean"]("x", 5)),
            "pull": f["safe_div"](F.col("x") - f["rolling_min"]("low", 4), f["rolling_max"]("high", 4)),
            "mix": f["interaction"](
                f["abs"](f["log1p"](f["abs"](f["delta"]("y", 2))) * f["sign"](F.col("t") - 2)), "y"
            ),
        }
    )
    df = cs.cs_pct_rank(df, {"rank": "trend"})
    df = cs.cs_zscore(df, {"z": "swing"})
    df = cs.industry_neutralize(df, {"neutral": "pull"})
    return tidy(df.select("stock_code", "trade_date", "trend", "swing", "pull", "mix", "rank", "z", "neutral"))


@query(
    "combine_factor_tables",
    sql(
        "price metric",
        f"""SELECT stock_code, trade_date, {rounded([P + 'ROC5', 'metric_pe', 'metric_log_total_mv'])} FROM
          (SELECT stock_code, trade_date, lag(close, 5) OVER ({ENTITY}) / close AS {P}ROC5 FROM price WHERE trade_date >= DATE '1997-01-01')
          FULL JOIN (SELECT stock_code, trade_date, pe AS metric_pe, ln(total_mv) AS metric_log_total_mv FROM metric
            WHERE trade_date < DATE '1999-07-01') USING (stock_code, trade_date)""",
    ),
)
def combine_factor_tables(spark, sf):
    """Two factor tables that cover different months, joined on their keys."""
    late = tables.price(spark, sf).where(F.col("trade_date") >= F.lit("1997-01-01").cast("date"))
    early = tables.metric(spark, sf).where(F.col("trade_date") < F.lit("1999-07-01").cast("date"))
    left = pf.price_factors(late, **{**NO_FAMILY, "return_windows": (5,)})
    right = vf.value_factors(early.select("stock_code", "trade_date", "pe", "total_mv"), delta_windows=(), mean_windows=())
    return tidy(
        combine([left, right]).df.select("stock_code", "trade_date", f"{P}ROC5", "metric_pe", "metric_log_total_mv")
    )


_WRITTEN = {f"{P}{n}": e for n, e in KBAR_SQL.items()} | _RETURN
_PRESENT_SQL = " UNION ALL ".join(
    [f"SELECT '{n}' AS factor_name, count(*) AS rows, count({n}) AS present FROM factor_bars" for n in _WRITTEN]
    + [f"SELECT '{n}', count(*), count({n}) FROM base" for n in METRIC_SQL]
)
_BARS_SQL = "factor_bars AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _WRITTEN.items()) + " FROM price)"


def written_blocks(spark, sf) -> dict[str, tuple]:
    """Two factor blocks, written and read back: the catalog row of each, the table, and its specs."""
    price = pf.price_factors(tables.price(spark, sf), relative=False, rolling_windows=())
    metric = vf.value_factors(tables.metric(spark, sf))
    out = {}
    for name, made in (("alpha158_bars", price), ("metric_daily", metric)):
        path = f"{stage_path(spark, 'block')}/{name}"
        row = sk.write_block(made.df, path, made.names)
        out[name] = row, spark.read.parquet(path), made
    return out


@query(
    "factor_catalog",
    sql(
        "price metric",
        f"""SELECT split_part(factor_name, '_', 1) AS source, factor_name, rows, present,
          CASE WHEN factor_name SIMILAR TO '.*(ROC|delta|_ma)[0-9]+' THEN CAST(regexp_extract(factor_name, '([0-9]+)$', 1) AS INTEGER) ELSE 0 END AS lookback
          FROM ({_PRESENT_SQL})""",
        METRIC_BASE,
        _BARS_SQL,
    ),
)
def factor_catalog(spark, sf):
    """The catalog of two written blocks beside the values found in them."""
    found = []
    for _, written, made in written_blocks(spark, sf).values():
        listed = catalog(spark, made.entries).select("source", F.col("name").alias("factor_name"), "lookback")
        found.append(listed.join(present_values(written, made.names), "factor_name"))
    return reduce(DataFrame.unionByName, found).select("source", "factor_name", "rows", "present", "lookback")


@query(
    "feature_groups",
    sql(
        "price metric",
        f"""SELECT feature_group, 'fundamental' AS modality, CAST(count(*) AS INTEGER) AS features, CAST(sum(present) AS BIGINT) AS present FROM (
          SELECT *, CASE WHEN factor_name LIKE 'metric%' THEN 'metric' WHEN factor_name LIKE '{P}ROC%' THEN 'alpha158_return' ELSE 'alpha158_kbar' END AS feature_group
          FROM ({_PRESENT_SQL})) GROUP BY ALL""",
        METRIC_BASE,
        _BARS_SQL,
    ),
)
def feature_groups(spark, sf):
    """Features and values per semantic group, from the columns of written blocks."""
    found = [
        present_values(written, [c for c in written.columns if c not in made.keys]).withColumn("block", F.lit(name))
        for name, (_, written, made) in written_blocks(spark, sf).items()
    ]
    rows = reduce(DataFrame.unionByName, found)
    # the block's name says nothing about the two price families; the feature's does
    feature, block = F.lower("factor_name"), F.when(F.col("block") != "alpha158_bars", F.col("block"))
    grouped = rows.select(feature_group(feature, block).alias("feature_group"), feature_modality(feature, block, ["news_"]).alias("modality"), "present")
    counts = F.count(F.lit(1)).cast("int").alias("features"), F.sum("present").alias("present")
    return grouped.groupBy("feature_group", "modality").agg(*counts)


@query(
    "catalog_checks",
    sql(
        "price metric",
        """SELECT 'alpha158_bars' AS name, concat_ws(';', CASE WHEN n <> kept THEN 'row count' END, 'missing:alpha158_KMID') AS problem, n AS row_count, kept AS rows
             FROM (SELECT count(*) AS n, count(lag5) AS kept FROM (SELECT lag(close, 5) OVER (PARTITION BY stock_code ORDER BY trade_date) AS lag5 FROM price))
           UNION ALL SELECT 'moneyflow_daily', 'not in catalog', NULL, count(*) FROM metric
           UNION ALL SELECT 'news_daily', 'not written', count(*), NULL FROM price""",
    ),
)
def catalog_checks(spark, sf):
    """A catalog against what is written: one block changed since, one never listed, one never written, one right."""
    blocks = written_blocks(spark, sf)
    listed = [(name, "daily", row["row_count"], len(made.names), made.names) for name, (row, _, made) in blocks.items()]
    listed.append(("news_daily", "daily", tables.price(spark, sf).count(), 1, ["news_count"]))
    rows = spark.createDataFrame(listed, BLOCK_SCHEMA)
    bars, metric = blocks["alpha158_bars"][1], blocks["metric_daily"][1]
    changed = f"{stage_path(spark, 'block')}/changed"
    bars.where(F.col(f"{P}ROC5").isNotNull()).drop(f"{P}KMID").write.parquet(changed)
    actual = [
        describe_block(spark.read.parquet(changed), "alpha158_bars"),
        describe_block(metric, "metric_daily"),
        describe_block(metric, "moneyflow_daily"),
    ]
    actual = reduce(DataFrame.unionByName, actual)
    found = block_problems(rows, actual).join(rows.select("name", "row_count"), "name", "left")
    return found.join(actual.select("name", "rows"), "name", "left")
