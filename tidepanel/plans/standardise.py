"""From raw market files to standard tables: price, basic, metric, flow, exclusion list, panel, samples.

Headers are resolved through alias lists, everything is read as text and typed by
projection. The steps keep their order: samples are made from the panel before
excluded days are removed, so labels see those days and samples that touch them
are dropped afterwards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.text import norm_code, norm_name, parse_date, sample_id
from tidepanel.operators.cross_section import median_fill
from tidepanel.operators.joins import attach_news_counts, attach_static, daily_panel
from tidepanel.operators.keys import exclude_exchange, exclude_keys, exclude_samples, keep_last
from tidepanel.operators.timeseries import forward_fill
from tidepanel.plans import news as nw
from tidepanel.plans.samples import prediction_samples
from tidepanel.scale import freeze
from tidepanel.sources.readers import (
    ROW_PLACE,
    SOURCE_FILE,
    find_column,
    find_files,
    load_many,
    numeric_columns,
    rename_by_alias,
)
from tidepanel.sources.sinks import preview, write_table

# Headers of key columns, of prices and metrics, and words in file paths.
DATE_HEADERS = nw.TIME_HEADERS
CODE_HEADERS = nw.CODE_HEADERS
NAME_HEADERS = nw.NAME_HEADERS
BASIC_CODE_HEADERS = ("ts_code", "wind_code", "stock_code", "code", "证券代码", "股票代码")
PRICE_ALIASES = {
    "open": ("open", "open_price", "开盘", "开盘价"),
    "high": ("high", "high_price", "最高", "最高价"),
    "low": ("low", "low_price", "最低", "最低价"),
    "close": ("close", "close_price", "收盘", "收盘价"),
    "preclose": ("preclose", "pre_close", "prev_close", "昨收", "昨收价"),
    "vwap": ("vwap", "avg_price", "均价"),
    "volume": ("volume", "vol", "成交量"),
    "amount": ("amount", "turnover", "成交额"),
}
METRIC_ALIASES = {
    "pe_ttm": ("pe_ttm", "pe", "市盈率"),
    "pb": ("pb", "市净率"),
    "roe": ("roe", "净资产收益率"),
}
PATH_HINTS = {
    "price": ("price", "kline", "quote", "daily", "行情"),
    "news": ("news", "article", "report", "公告", "新闻"),
    "metric": ("metric",),
    "moneyflow": ("moneyflow",),
    "stock_st": ("stock_st",),
}
SUMMARY_RULES = {"rows": "rows", "duplicate": "duplicates_removed", "exchange": "exchange_removed", "special": "special_removed"}
PRICE_COLUMNS = ("preclose", "close", "open", "high", "low", "vwap")
ZERO_FILLED = ("volume", "amount")
STATIC_FIELDS = ("stock_name", "industry", "market", "area", "list_date")


def _keyed(df: DataFrame, what: str, with_name: bool = False) -> DataFrame:
    """Key columns under their standard names; rows without a date or code dropped."""
    date, code = find_column(df.columns, DATE_HEADERS), find_column(df.columns, CODE_HEADERS)
    if not date or not code:
        raise ValueError(f"{what} has no date or code column")
    renames = {date: "trade_date", code: "stock_code"}
    name = find_column(df.columns, NAME_HEADERS)
    if name:
        renames[name] = "stock_name"
    out = df.withColumnsRenamed(renames).withColumns(
        {"trade_date": parse_date("trade_date"), "stock_code": norm_code("stock_code")}
    )
    if name:
        out = out.withColumn("stock_name", norm_name("stock_name"))
    return out.dropna(subset=["trade_date", "stock_code"])


def _renamed(raw: DataFrame, kind: str) -> DataFrame:
    """Raw columns under their standard names."""
    if kind == "price":
        return rename_by_alias(raw, PRICE_ALIASES)
    if kind == "metric":
        for target, names in METRIC_ALIASES.items():
            if target not in raw.columns:
                raw = rename_by_alias(raw, {target: names})
    return raw


def _last_row(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: the last in order of files and lines; rows without a place go by file and a hash of the row."""
    order = [c for c in (ROW_PLACE, SOURCE_FILE) if c in df.columns]
    rest = [c for c in df.columns if c not in (*keys, *order)]
    return keep_last(df, keys, [*order, F.xxhash64(*rest) if rest else F.lit(0)]).drop(ROW_PLACE)


def _last_per_day(df: DataFrame) -> DataFrame:
    return _last_row(df, ["stock_code", "trade_date"])


def prepare_price(raw: DataFrame) -> DataFrame:
    """One bar per entity and day, gaps filled.

    Prices are carried forward, volume and amount become zero, other numbers are
    carried forward and then take the day's median; what is still missing of a
    bar's prices takes its close.
    """
    df = numeric_columns(
        _keyed(_renamed(raw, "price"), "price"), ("trade_date", "stock_code", "stock_name", SOURCE_FILE, ROW_PLACE)
    )
    df = _last_per_day(df)
    numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "long", "integer")]
    prices = [c for c in PRICE_COLUMNS if c in df.columns]
    zeros = [c for c in ZERO_FILLED if c in df.columns]
    others = [c for c in numbers if c not in prices and c not in zeros]
    df = df.withColumns(
        {
            **{c: forward_fill(c) for c in [*prices, *others]},
            **{c: F.coalesce(F.col(c), F.lit(0.0)) for c in zeros},
        }
    )
    if others:
        df = median_fill(df, others)
    if "close" in prices:
        df = df.withColumns({c: F.coalesce(F.col(c), F.col("close")) for c in prices if c != "close"})
    return df.withColumn("sample_id", sample_id("stock_code", "trade_date"))


def prepare_basic(raw: DataFrame) -> DataFrame:
    """One row of static fields per entity."""
    code, name = find_column(raw.columns, BASIC_CODE_HEADERS), find_column(raw.columns, NAME_HEADERS)
    if not code:
        raise ValueError("basic has no code column")
    columns = [norm_code(code).alias("stock_code")]
    if name:
        columns.append(norm_name(name).alias("stock_name"))
    for c in ("industry", "market", "area"):
        if c in raw.columns:
            columns.append(F.col(c))
    if "list_date" in raw.columns:
        columns.append(parse_date("list_date").alias("list_date"))
    source = [F.col(SOURCE_FILE)] if SOURCE_FILE in raw.columns else [F.lit("").alias(SOURCE_FILE)]
    places = [F.col(ROW_PLACE)] if ROW_PLACE in raw.columns else []
    df = raw.select(*columns, *source, *places).where(F.col("stock_code").isNotNull())
    return _last_row(df, ["stock_code"]).drop(SOURCE_FILE)


def prepare_metric(raw: DataFrame) -> DataFrame:
    """One metric row per entity and day."""
    skip = ("trade_date", "stock_code", "stock_name", SOURCE_FILE, ROW_PLACE)
    return _last_per_day(numeric_columns(_keyed(_renamed(raw, "metric"), "metric"), skip))


def prepare_flow(raw: DataFrame) -> DataFrame:
    """One money-flow row per entity and day."""
    return _last_per_day(numeric_columns(_keyed(raw, "moneyflow"), ("trade_date", "stock_code", SOURCE_FILE, ROW_PLACE)))


def prepare_exclusions(raw: DataFrame) -> DataFrame:
    """One row per entity and day under special treatment."""
    df = _keyed(raw, "exclusion list")
    kept = [c for c in ("stock_code", "stock_name", "trade_date", "type", "type_name", SOURCE_FILE, ROW_PLACE) if c in df.columns]
    return _last_per_day(df.select(*kept))


@dataclass(frozen=True)
class StandardTables:
    """The standard tables of one run; absent inputs are None.

    ``steps`` holds, per table and rule, the rows before and after the rule.
    """

    price: DataFrame
    panel: DataFrame
    samples: DataFrame
    basic: DataFrame | None = None
    metric: DataFrame | None = None
    moneyflow: DataFrame | None = None
    stock_st: DataFrame | None = None
    news: DataFrame | None = None
    news_stock_daily: DataFrame | None = None
    news_market_daily: DataFrame | None = None
    news_stock_texts: DataFrame | None = None
    news_market_texts: DataFrame | None = None
    steps: Mapping[tuple[str, str], tuple[DataFrame, DataFrame]] = field(default_factory=dict)

    def present(self) -> dict[str, DataFrame]:
        return {name: df for name, df in vars(self).items() if df is not None and name != "steps"}


def standardise(raw: Mapping[str, DataFrame | None], cutoff_hour: int = 15) -> StandardTables:
    """All standard tables from raw tables by kind: price, basic, metric, moneyflow, stock_st, news."""
    if raw.get("price") is None:
        raise ValueError("no price files")
    have = lambda kind: raw.get(kind) is not None
    steps: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}
    basic = freeze(prepare_basic(raw["basic"]), "basic") if have("basic") else None
    made = {"price": prepare_price(raw["price"])}
    for kind, prepare in (("metric", prepare_metric), ("moneyflow", prepare_flow)):
        if have(kind):
            made[kind] = prepare(raw[kind])
    if basic is not None:
        made = {kind: attach_static(df, basic, *([STATIC_FIELDS] if kind == "price" else [])) for kind, df in made.items()}
    # these are results of their own and read by everything below, so they are written here
    whole = {kind: freeze(df, kind) for kind, df in made.items()}
    if have("stock_st"):
        whole["stock_st"] = freeze(prepare_exclusions(raw["stock_st"]), "exclusions")
    for kind, df in whole.items():
        steps[kind, "duplicate"] = _keyed(_renamed(raw[kind], kind), kind), df
    listed = whole.pop("stock_st", None)
    traded = {kind: exclude_exchange(df) for kind, df in whole.items()}
    steps |= {(kind, "exchange"): (whole[kind], df) for kind, df in traded.items()}

    panel = daily_panel(*traded.values())
    samples = prediction_samples(panel)
    out = {**traded, "panel": panel, "samples": samples}
    if listed is not None:
        clean = {kind: (exclude_samples if kind == "samples" else exclude_keys)(df, listed) for kind, df in out.items()}
        steps |= {(kind, "special"): (out[kind], df) for kind, df in clean.items()}
        out = clean

    if have("news"):
        detail = freeze(nw.prepare_news(raw["news"], out["price"], cutoff_hour), "news")
        rows = nw.stock_rows(detail)
        out["news_stock_texts"] = nw.joined_texts(rows, ["stock_code", "trade_date"], nw.STOCK_TEXT, texts=detail)
        out["news_market_texts"] = nw.joined_texts(detail, ["trade_date"], nw.MARKET_TEXT, texts=detail)
        out["news_stock_daily"] = nw.stock_daily(rows)
        out["news_market_daily"] = nw.market_daily(detail, out["price"].select("trade_date"))
        out["news"] = detail.drop("codes", "title_text", *nw.MARKS)
        out["samples"] = attach_news_counts(out["samples"], out["news_stock_daily"], out["news_market_daily"])
    once = keep_last(out["samples"], ["sample_id"], ["feature_asof_date"])
    steps["samples", "duplicate"] = out["samples"], once
    return StandardTables(**{**out, "samples": once}, basic=basic, stock_st=listed, steps=steps)


def read_raw(spark: SparkSession, root: str, basic: Sequence[str] = ()) -> dict[str, DataFrame | None]:
    """Raw tables of a folder, found by words in the file paths."""
    raw = {kind: load_many(spark, find_files(spark, root, hints), places=kind != "news") for kind, hints in PATH_HINTS.items()}
    raw["basic"] = load_many(spark, list(basic), places=True) if basic else None
    return raw


def run_summary(tables: StandardTables) -> DataFrame:
    """Rows of each table and how many each rule removed: duplicates, exchange, special treatment. One job."""
    counts = [_counted(df, name, "rows") for name, df in tables.present().items()]
    for (name, rule), (before, after) in tables.steps.items():
        counts += [_counted(before, name, rule), _counted(after, name, rule, -1)]
    total = reduce(DataFrame.unionByName, counts).groupBy("table_name")
    return total.agg(*[F.sum(F.when(F.col("rule") == r, F.col("n"))).alias(c) for r, c in SUMMARY_RULES.items()])


def _counted(df: DataFrame, name: str, rule: str, sign: int = 1) -> DataFrame:
    return df.agg((F.count(F.lit(1)) * sign).alias("n")).select(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), "n")


def save(tables: StandardTables, folder: str) -> dict[str, str]:
    """Write every table as parquet and a preview of the samples."""
    paths = {}
    for name, df in tables.present().items():
        paths[name] = write_table(df, f"{folder.rstrip('/')}/{name}")
    paths["samples_preview"] = write_table(
        preview(tables.samples, ["stock_code", "trade_date"]), f"{folder.rstrip('/')}/samples_preview", "csv"
    )
    return paths
