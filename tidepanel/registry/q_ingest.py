"""Reading, standardising and writing tables; files are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.text import norm_name, parse_time, sample_id, to_half_width
from tidepanel.operators import joins as jn
from tidepanel.operators.keys import keep_last
from tidepanel.plans import standardise as st
from tidepanel.plans.price_factors import price_factors
from tidepanel.registry import tables
from tidepanel.registry.base import query, rounded, tidy
from tidepanel.registry.tables import sql, table
from tidepanel.scale import freeze, stage_path
from tidepanel.sources import readers as rd
from tidepanel.sources import sinks as sk


def _csv(df: DataFrame, name: str, sep: str = ",", suffix: str = "csv") -> str:
    path = f"{stage_path(df.sparkSession, 'raw')}/{name}"
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


_HARD_TEXT = "chr(10) || 'line; \"' || text || '\"; end'"


@query(
    "read_delimited",
    f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(coalesce({_HARD_TEXT}, '')) AS text_md5, lang, 1 AS files FROM documents",
)
def read_delimited(spark, sf):
    """Semicolon-separated texts with line breaks, quotes and delimiters inside; the delimiter is found out."""
    docs = table(spark, sf, "documents").select("doc_id", F.expr(_HARD_TEXT.replace("chr(10)", "char(10)")).alias("text"), "lang")
    path = f"{stage_path(spark, 'raw')}/documents.csv"
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs.write.options(header=True, sep=";", escape='"', **keep).csv(path)
    out = rd.read_delimited(spark, path)
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", digest.alias("text_md5"), "lang", out[rd.SOURCE_FILE].isNotNull().cast("int").alias("files"))


@query(
    "last_line_per_key",
    """SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""",
)
def last_line_per_key(spark, sf):
    """The last line of each customer in files that are read in many blocks; lines are written in order of o_orderkey."""
    path = f"{stage_path(spark, 'raw')}/orders.csv"
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    orders.repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey").write.options(header=True, escape='"').csv(path)
    lines = rd.read_delimited(spark, path, multi_line=False, places=True)
    return keep_last(lines, ["o_custkey"], [rd.ROW_PLACE]).select("o_custkey", "o_orderkey")


_SINK_SQL = "SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal, s_nationkey FROM supplier"


def _through_sink(spark, sf, kind: str, read):
    """Suppliers written by the sink and read again, nation by nation in folders of their own."""
    path = f"{stage_path(spark, 'sink')}/suppliers"
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    back = read(sk.write_table(suppliers, path, kind, ["s_nationkey"]))
    kinds = {f.name: f.dataType for f in suppliers.schema.fields}
    cast = {c: F.col(c).cast(k) for c, k in kinds.items()}
    return back.select(*[F.round(x, 2).alias(c) if c == "s_acctbal" else x.alias(c) for c, x in cast.items()])


@query("csv_sink_round_trip", _SINK_SQL)
def csv_sink_round_trip(spark, sf):
    """A table through the CSV sink, partitioned."""
    return _through_sink(spark, sf, "csv", lambda p: rd.read_delimited(spark, p, sep=","))


@query("json_sink_round_trip", _SINK_SQL)
def json_sink_round_trip(spark, sf):
    """A table through the JSON sink, partitioned."""
    return _through_sink(spark, sf, "json", lambda p: rd.read_json(spark, p, lines=True))


@query("parquet_sink_round_trip", _SINK_SQL)
def parquet_sink_round_trip(spark, sf):
    """A table through the Parquet sink, partitioned."""
    return _through_sink(spark, sf, "parquet", lambda p: rd.read_parquet(spark, p))


@query(
    "read_json_forms",
    "SELECT 'lines' AS form, r_regionkey::BIGINT AS r_regionkey, r_name FROM region UNION ALL SELECT 'envelope', r_regionkey::BIGINT, r_name FROM region",
)
def read_json_forms(spark, sf):
    """JSON lines, and rows inside an object."""
    region = table(spark, sf, "region")
    lines, envelope = f"{stage_path(spark, 'raw')}/region.jsonl", f"{stage_path(spark, 'raw')}/region.json"
    region.write.json(lines)
    whole = region.agg(F.collect_list(F.struct("r_regionkey", "r_name")).alias("items"))
    whole.select(F.to_json(F.struct("items")).alias("value")).write.text(envelope)
    parts = [
        rd.read_json(spark, p).select(F.lit(form).alias("form"), "r_regionkey", "r_name")
        for form, p in (("lines", lines), ("envelope", envelope))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "union_many_files",
    """SELECT doc_id::VARCHAR AS doc_id, md5(coalesce(text, '')) AS text_md5, CASE WHEN doc_id % 3 = 0 THEN source END AS source,
      CASE doc_id % 3 WHEN 0 THEN 'wide' WHEN 1 THEN 'narrow' ELSE 'json' END AS origin FROM documents""",
)
def union_many_files(spark, sf):
    """Files of other columns and kinds, found by words in their path, with the file they come from."""
    root = stage_path(spark, "raw")
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "source")
    part = lambda k: docs.where(F.col("doc_id").cast("bigint") % 3 == k)
    part(0).write.options(header=True, escape='"').csv(f"{root}/Daily_wide")
    part(1).drop("source").repartition(4).write.options(header=True, escape='"').csv(f"{root}/daily_narrow")
    part(2).drop("source").write.json(f"{root}/daily_json")
    docs.write.options(header=True, escape='"').csv(f"{root}/other")
    files = [f for f in rd.find_files(spark, root, ("daily",)) if f.endswith((".csv", ".json"))]
    csv = rd.load_many(spark, [f for f in files if f.endswith(".csv")])
    lines = rd.with_source_file(spark.read.json([f for f in files if f.endswith(".json")]))
    out = rd.union_tables([csv, lines])
    origin = F.regexp_extract(F.col(rd.SOURCE_FILE), "(?i)daily_(wide|narrow|json)", 1)
    return out.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "source", origin.alias("origin"))


@query(
    "select_files_by_date",
    """SELECT path, file_date FROM (SELECT DISTINCT 'raw/' || strftime(d, '%Y-%m-%d') || '/quote.csv' AS path, d AS file_date FROM dated)
      WHERE file_date > (SELECT max(d) FROM dated WHERE d < DATE '2009-03-10') AND file_date <= DATE '2009-12-31'""".replace(
        "SELECT path", "WITH dated AS (SELECT CAST(o_orderdate + INTERVAL 10 YEAR AS DATE) AS d FROM orders) SELECT path", 1
    ),
)
def select_files_by_date(spark, sf):
    """Paths dated after the newest loaded one and up to an end date."""
    day = F.add_months(F.col("o_orderdate").cast("date"), 120)
    orders = table(spark, sf, "orders").select(day.alias("d")).distinct()
    paths = orders.select(F.concat(F.lit("raw/"), F.date_format("d", "yyyy-MM-dd"), F.lit("/quote.csv")).alias("path"), "d")
    loaded = paths.where(F.col("d") < F.lit("2009-03-10").cast("date"))
    out = rd.select_by_path_date(paths.select("path"), None, "2009-12-31", loaded)
    return out.select("path", "file_date")


@query(
    "scan_date_range",
    "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-05-01' AND TIMESTAMP '1997-05-31'",
)
def scan_date_range(spark, sf):
    """One month of three columns; range and columns reach the file scan."""
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("1997-05-01", "1997-05-31"))
    return rd.scan_range(spark, f"{sf}/lineitem.parquet", "l_shipdate", start, end, ("l_orderkey", "l_linenumber", "l_shipdate"))


@query(
    "factor_block_roundtrip",
    sql(
        "price",
        "SELECT stock_code, trade_date, round((close - open) / open, 6) + 0 AS alpha158_KMID, true AS complete, "
        "(SELECT count(*) FROM price) AS row_count FROM price",
    ),
)
def factor_block_roundtrip(spark, sf):
    """A block written whole, checked, read back, and known to be complete."""
    factors = price_factors(tables.price(spark, sf), relative=False, return_windows=(), rolling_windows=())
    path = f"{stage_path(spark, 'block')}/kbar"
    row = sk.write_block(factors.df, path, factors.names)
    done = sk.block_is_complete(spark, path, row["row_count"], factors.names, factors.keys)
    out = spark.read.parquet(path).select("stock_code", "trade_date", "alpha158_KMID")
    return tidy(out.withColumns({"complete": F.lit(done), "row_count": F.lit(row["row_count"]).cast("bigint")}))


@query(
    "read_predictions_file",
    sql("predictions", "SELECT sample_id, stock_code, round(final_score, 6) + 0 AS final_score FROM predictions"),
)
def read_predictions_file(spark, sf):
    """Predictions written as CSV and read back by extension."""
    df = tables.predictions(spark, sf).select("sample_id", "stock_code", "final_score")
    path = _csv(df, "predictions.csv")
    return tidy(rd.read_predictions(spark, path))


@query(
    "rename_by_alias",
    "SELECT p_partkey AS stock_code, p_retailprice AS close, p_size::DOUBLE AS volume FROM part",
)
def rename_by_alias(spark, sf):
    """Headers in other spellings mapped to standard names."""
    raw = table(spark, sf, "part").select(
        F.col("p_partkey").alias("stock_code"), F.col("p_retailprice").alias("Close_Price"), F.col("p_size").cast("double").alias("成交量")
    )
    return rd.rename_by_alias(raw, st.PRICE_ALIASES).select("stock_code", "close", "volume")


@query(
    "parse_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 IN (0, 3) THEN o_orderdate + INTERVAL 9 HOUR + INTERVAL 30 MINUTE ELSE o_orderdate END AS time FROM orders""",
)
def parse_dates(spark, sf):
    """Times from compact, dashed and slashed text; nonsense becomes missing."""
    d, n = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = (
        F.when(n == 0, F.concat(F.date_format(d, "yyyyMMdd"), F.lit("093000")))
        .when(n == 1, F.concat(F.lit(" "), F.date_format(d, "yyyyMMdd"), F.lit(" ")))
        .when(n == 2, F.date_format(d, "yyyy/M/d"))
        .when(n == 3, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 09:30")))
        .otherwise(F.concat(F.lit("day "), F.col("o_orderkey").cast("string")))
    )
    return table(spark, sf, "orders").select("o_orderkey", parse_time(text).alias("time"))


@query(
    "numeric_columns",
    "SELECT p_partkey::DOUBLE AS p_partkey, p_retailprice, CASE WHEN p_partkey % 50 = 0 THEN 'n/a' ELSE p_size::VARCHAR END AS size FROM part",
)
def numeric_columns(spark, sf):
    """Text columns become numbers only if every value is one."""
    part = table(spark, sf, "part")
    raw = part.select(
        F.col("p_partkey").cast("string").alias("p_partkey"),
        F.col("p_retailprice").cast("string").alias("p_retailprice"),
        F.when(F.col("p_partkey") % 50 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("size"),
    )
    return rd.numeric_columns(raw)


@query(
    "norm_names_and_ids",
    "SELECT s_name AS stock_name, s_name AS half, s_name || '_' || '2020-01-31' AS sample_id FROM supplier",
)
def norm_names_and_ids(spark, sf):
    """Names without blanks, half-width forms, sample ids."""
    name = F.col("s_name")
    spaced = F.concat(F.lit("　"), F.substring(name, 1, 4), F.lit(" \t"), F.expr("substring(s_name, 5)"), F.lit(" "))
    wide = F.translate(name, "Suplier0123456789", "Ｓｕｐｌｉｅｒ０１２３４５６７８９")
    return table(spark, sf, "supplier").select(
        norm_name(spaced).alias("stock_name"),
        to_half_width(wide).alias("half"),
        sample_id(name, F.lit("2020-01-31").cast("date")).alias("sample_id"),
    )


# -- joins of standard tables ------------------------------------------------------------


@query(
    "attach_static_fields",
    sql(
        "bars basic",
        """SELECT b.stock_code, trade_date, CASE WHEN mno % 4 = 0 THEN 'own' ELSE s.industry END AS industry, s.sector AS area FROM bars b
          LEFT JOIN basic s ON s.stock_code = b.stock_code AND s.balance > 0""",
    ),
)
def attach_static_fields(spark, sf):
    """Static fields where the table has none of its own."""
    bars = tables.bars(spark, sf).withColumn("industry", F.when(F.col("mno") % 4 == 0, "own"))
    basic = tables.basic(spark, sf).where(F.col("balance") > 0).withColumnRenamed("sector", "area")
    return jn.attach_static(bars, basic, ("industry", "area")).select("stock_code", "trade_date", "industry", "area")


@query(
    "fill_blank_industry",
    sql(
        "price basic",
        """SELECT p.stock_code, trade_date, CASE WHEN trim(p.industry) <> '' AND mno % 3 <> 0 THEN p.industry ELSE b.sector END AS industry
          FROM price p LEFT JOIN basic b USING (stock_code)""",
    ),
)
def fill_blank_industry(spark, sf):
    """Blank or missing industries filled from the static table."""
    price = tables.price(spark, sf).withColumn("industry", F.when(F.col("mno") % 3 == 0, " ").otherwise(F.col("industry")))
    basic = tables.basic(spark, sf).select("stock_code", F.col("sector").alias("industry"))
    return jn.fill_blank_industry(price, basic).select("stock_code", "trade_date", "industry")


@query(
    "daily_panel",
    sql(
        "price metric flow",
        f"""SELECT stock_code, trade_date, {rounded(['close', 'pb', 'net_mf_amount'])} FROM price
          LEFT JOIN (SELECT stock_code, trade_date, pb FROM metric WHERE month(trade_date) <> 2) m USING (stock_code, trade_date)
          LEFT JOIN flow USING (stock_code, trade_date)""",
    ),
)
def daily_panel(spark, sf):
    """Prices with metric and money flow of the same day."""
    metric = tables.metric(spark, sf).where(F.month("trade_date") != 2)
    panel = jn.daily_panel(tables.price(spark, sf), metric, tables.flow(spark, sf))
    return tidy(panel.select("stock_code", "trade_date", "close", "pb", "net_mf_amount"))


# -- whole standardisation -----------------------------------------------------------------


def _raw(spark, sf) -> dict[str, DataFrame]:
    """Raw files with foreign headers, duplicates, gaps and text dates, all made from the price panel."""
    k, m = F.col("k"), F.col("mno")
    price = freeze(tables.price(spark, sf), "price")
    text = lambda c: F.col(c).cast("string")
    bars = price.select(
        F.col("stock_code").alias("ts_code"),
        F.date_format("trade_date", "yyyyMMdd").alias("trade_date"),
        F.when((k + m) % 5 != 0, text("open")).alias("Open"),
        F.when((k + m) % 7 != 0, text("close")).alias("收盘价"),
        text("vwap").alias("vwap"),
        F.when((k + m) % 6 != 0, text("volume")).alias("vol"),
        F.when((k * 3 + m) % 4 != 0, text("n_lines")).alias("lines"),
        F.lit("a").alias(rd.SOURCE_FILE),
    )
    again = bars.where(F.col("trade_date").substr(5, 2) == "06").withColumns({"vwap": F.lit("1.0"), rd.SOURCE_FILE: F.lit("b")})
    basic = tables.basic(spark, sf).select(F.col("stock_code").alias("wind_code"), F.col("stock_name").alias("简称"), "industry",
                                           F.when(F.col("stock_code").endswith("7.SZ"), "北交所").otherwise("main").alias("market"))
    metric = tables.metric(spark, sf, price).select(
        F.col("stock_code").alias("code"), F.date_format("trade_date", "yyyy-MM-dd").alias("date"), text("pb").alias("市净率")
    )
    listed = price.where(F.col("close") > F.col("open") * 12).select(
        F.col("stock_code").alias("ts_code"), F.date_format("trade_date", "yyyyMMdd").alias("trade_date"), F.lit("ST").alias("type")
    )
    raw = {"price": bars.unionByName(again), "basic": basic, "metric": metric, "stock_st": listed}
    return {kind: freeze(df, "raw") for kind, df in raw.items()}


_STANDARD = """raw_bars AS (SELECT stock_code, trade_date, mno, k, CASE WHEN (k + mno) % 5 <> 0 THEN open END AS o, CASE WHEN (k + mno) % 7 <> 0 THEN close END AS c,
    CASE WHEN month(trade_date) = 6 THEN 1.0 ELSE vwap END::DOUBLE AS vwap, CASE WHEN (k + mno) % 6 <> 0 THEN volume ELSE 0 END AS volume,
    CASE WHEN (k * 3 + mno) % 4 <> 0 THEN n_lines END::DOUBLE AS lines FROM price),
carried AS (SELECT * REPLACE (last_value(o IGNORE NULLS) OVER w AS o, last_value(c IGNORE NULLS) OVER w AS c, last_value(lines IGNORE NULLS) OVER w AS lines) FROM raw_bars
    WINDOW w AS (PARTITION BY stock_code ORDER BY trade_date ROWS UNBOUNDED PRECEDING)),
std_price AS (SELECT s.stock_code, s.trade_date, k, mno, coalesce(o, c) AS open, c AS close, coalesce(vwap, c) AS vwap, volume,
    coalesce(lines, quantile_cont(lines, 0.5) OVER (PARTITION BY s.trade_date)) AS lines FROM carried s),
on_exchange AS (SELECT p.*, m.pb FROM std_price p LEFT JOIN metric m USING (stock_code, trade_date)
    WHERE NOT ends_with(p.stock_code, '.BJ') AND NOT ends_with(p.stock_code, '7.SZ')),
listed_days AS (SELECT stock_code, trade_date FROM price WHERE close > 12 * open)"""


@query(
    "prepare_price",
    sql("price", f"SELECT stock_code, trade_date, vwap, {rounded(['open', 'close', 'volume', 'lines'])} FROM std_price",
        _STANDARD.split(",\non_exchange")[0]),
)
def prepare_price(spark, sf):
    """Raw bars typed, deduplicated and filled."""
    out = st.prepare_price(_raw(spark, sf)["price"])
    return tidy(out.select("stock_code", "trade_date", "open", "close", "vwap", "volume", "lines"), keep=["vwap"])


@query(
    "standard_panel",
    sql(
        "price metric",
        f"SELECT stock_code, trade_date, vwap, pb, {rounded(['open', 'close', 'volume', 'lines'])} FROM on_exchange ANTI JOIN listed_days USING (stock_code, trade_date)",
        _STANDARD,
    ),
)
def standard_panel(spark, sf):
    """The standardised panel: one exchange and listed days left out."""
    out = st.standardise(_raw(spark, sf)).panel
    return tidy(out.select("stock_code", "trade_date", "open", "close", "vwap", "volume", "lines", "pb"), keep=["vwap", "pb"])


@query(
    "standard_samples",
    sql(
        "price metric",
        f"""SELECT stock_code || '_' || strftime(target, '%Y-%m-%d') AS sample_id, feature_asof_date, target AS target_trade_date, {rounded(['label_next_open_return'], 5)} FROM (
          SELECT stock_code, trade_date AS feature_asof_date, lead(trade_date) OVER w AS target, lead(trade_date, 2) OVER w AS ending,
            lead(open, 2) OVER w / nullif(lead(open) OVER w, 0) - 1 AS label_next_open_return FROM on_exchange WINDOW w AS (PARTITION BY stock_code ORDER BY trade_date)) s
          WHERE target IS NOT NULL AND ending IS NOT NULL AND NOT EXISTS (SELECT 1 FROM listed_days b WHERE b.stock_code = s.stock_code
            AND b.trade_date IN (s.feature_asof_date, s.target, s.ending))""",
        _STANDARD,
    ),
)
def standard_samples(spark, sf):
    """Samples of the whole standardisation; labels still see excluded days."""
    out = st.standardise(_raw(spark, sf)).samples
    return tidy(out.select("sample_id", "feature_asof_date", "target_trade_date", "label_next_open_return"), 5)


_LISTED = "ANTI JOIN listed_days USING (stock_code, trade_date)"


def _left_sql(name: str, source: str, duplicates: str) -> str:
    return f"""SELECT '{name}' AS table_name, (SELECT count(*) FROM on_exchange {_LISTED}) AS rows, {duplicates} AS duplicates_removed,
      (SELECT count(*) FROM {source}) - (SELECT count(*) FROM on_{'metric' if name == 'metric' else 'exchange'}) AS exchange_removed,
      (SELECT count(*) FROM on_exchange) - (SELECT count(*) FROM on_exchange {_LISTED}) AS special_removed"""


@query(
    "run_summary",
    sql(
        "price metric",
        f"""{_left_sql('price', 'price', '(SELECT count(*) FROM price WHERE month(trade_date) = 6)')}
          UNION ALL {_left_sql('metric', 'metric', '0')}
          UNION ALL SELECT 'stock_st', (SELECT count(*) FROM listed_days), 0, NULL, NULL
          UNION ALL SELECT 'basic', (SELECT count(*) FROM supplier), NULL, NULL, NULL
          UNION ALL SELECT 'panel', (SELECT count(*) FROM on_exchange {_LISTED}), NULL, NULL, (SELECT count(*) FROM on_exchange) - (SELECT count(*) FROM on_exchange {_LISTED})
          UNION ALL SELECT 'samples', (SELECT count(*) FROM made WHERE clean), 0, NULL, (SELECT count(*) FROM made WHERE NOT clean)""",
        _STANDARD,
        """on_metric AS (SELECT * FROM metric WHERE NOT ends_with(stock_code, '.BJ') AND NOT ends_with(stock_code, '7.SZ')),
        made AS (SELECT NOT EXISTS (SELECT 1 FROM listed_days b WHERE b.stock_code = s.stock_code AND b.trade_date IN (s.trade_date, s.target, s.ending)) AS clean FROM (
          SELECT stock_code, trade_date, lead(trade_date) OVER w AS target, lead(trade_date, 2) OVER w AS ending FROM on_exchange
          WINDOW w AS (PARTITION BY stock_code ORDER BY trade_date)) s WHERE target IS NOT NULL AND ending IS NOT NULL)""",
    ),
)
def run_summary(spark, sf):
    """Rows of all standard tables and the rows each rule removed."""
    return st.run_summary(st.standardise(_raw(spark, sf)))


# -- long and wide ---------------------------------------------------------------------------


@query(
    "melt_and_pivot",
    sql(
        "price",
        """SELECT trade_date, round(avg(open), 4) + 0 AS open, round(avg(close), 4) + 0 AS close, round(avg(vwap), 4) + 0 AS vwap FROM price GROUP BY 1""",
    ),
)
def melt_and_pivot(spark, sf):
    """Columns to rows and back to columns of means."""
    long = tables.price(spark, sf).unpivot(["stock_code", "trade_date"], ["open", "close", "vwap"], "field", "value")
    return tidy(long.groupBy("trade_date").pivot("field", ["open", "close", "vwap"]).agg(F.avg("value")), 4)


@query(
    "set_operations",
    """SELECT 'both' AS part, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
      UNION ALL SELECT 'only_f', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
      UNION ALL SELECT 'pairs', count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)""",
)
def set_operations(spark, sf):
    """Intersection, difference and distinct pairs of ids."""
    orders = table(spark, sf, "orders")
    f = orders.where(F.col("o_orderstatus") == "F").select("o_custkey")
    o = orders.where(F.col("o_orderstatus") == "O").select("o_custkey")
    parts = {
        "both": jn.in_all([f.withColumnRenamed("o_custkey", "id"), o.withColumnRenamed("o_custkey", "id")], "id"),
        "only_f": f.distinct().join(o, "o_custkey", "left_anti"),
        "pairs": orders.select("o_custkey", "o_orderstatus").dropDuplicates(),
    }
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("part"), "n") for p, df in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


