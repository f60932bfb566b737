"""News preparation from the documents, event windows from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.text import norm_code, sample_id
from tidepanel.operators.joins import attach_news_counts, forward_trade_day
from tidepanel.plans import event_scores as es
from tidepanel.plans import news as nw
from tidepanel.plans import news_factors as nf
from tidepanel.registry import tables
from tidepanel.registry.base import query, rounded, tidy
from tidepanel.registry.tables import code_of, code_sql, define, sql, table
from tidepanel.scale import freeze, spread


# -- raw news ----------------------------------------------------------------------


def raw_news(spark, sf) -> DataFrame:
    """Documents as news rows: a time, a title naming two suppliers, content with codes, sometimes a code column."""
    d = F.col("doc_id")
    names = tables.basic(spark, sf).join(
        table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), code_of(F.col("s_suppkey")).alias("stock_code")),
        "stock_code",
    )
    names = freeze(names.select("k", "stock_name", "stock_code"), "names")  # so that its size is known where texts meet it
    known = table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("n")).scalar()
    docs = table(spark, sf, "documents").withColumns({"a": d % known, "b": (d * 7 + 3) % known})
    one = names.select(F.col("k").alias("a"), F.col("stock_name").alias("name_a"), F.col("stock_code").alias("code_a"))
    two = names.select(F.col("k").alias("b"), F.col("stock_name").alias("name_b"), F.col("stock_code").alias("code_b"))
    work = docs.join(one, "a", "left").join(two, "b", "left")
    seconds = (d * 7919311) % (5 * 365 * 86400)
    return work.select(
        F.date_format(F.lit("1996-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds), "yyyyMMddHHmmss").alias("datetime"),
        F.concat(F.lit("On "), F.coalesce("name_a", F.lit("none")),
                 F.when(d % 3 == 0, F.concat(F.lit(" and "), F.coalesce("name_b", F.lit("none")))).otherwise("")).alias("title"),
        F.concat("text", F.lit(" "), F.when(d % 4 == 0, F.coalesce("code_b", F.lit(""))).otherwise(""), F.lit(" 123456789")).alias("content"),
        F.when(d % 5 == 0, F.concat(F.lit(" "), F.lower("code_a"))).when(d % 11 == 0, F.substring("code_b", 1, 6)).alias("code"),
        F.concat(F.lit("file"), (d % 3).cast("string")).alias("__source_file"),
        "doc_id",
        "name_a", "name_b", "code_a", "code_b",
    )


def stored(spark, sf) -> DataFrame:
    """News rows with their texts, stored once."""
    return nw.stored_news(raw_news(spark, sf).drop("name_a", "name_b", "code_a", "code_b", "doc_id"))


def detail(spark, sf, news: DataFrame | None = None) -> DataFrame:
    return nw.prepare_news(stored(spark, sf) if news is None else news, trading(spark, sf))


def trading(spark, sf) -> DataFrame:
    """Codes, names and trading days: entities of the price table with the weekdays of ship dates."""
    names = tables.basic(spark, sf).select("stock_code", "stock_name")
    days = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("trade_date")).distinct()
    days = days.where(F.weekday("trade_date") < 5)
    return days.withColumns({"stock_code": F.lit(None).cast("string"), "stock_name": F.lit(None).cast("string")}).unionByName(
        names.withColumn("trade_date", F.lit(None).cast("date"))
    )


define(
    "raw_news",
    f"""raw_news AS (
  SELECT TIMESTAMP '1996-01-01' + to_seconds((doc_id * 7919311) % {5 * 365 * 86400}) AS publish_time,
    'On ' || coalesce(a.stock_name, 'none') || CASE WHEN doc_id % 3 = 0 THEN ' and ' || coalesce(b.stock_name, 'none') ELSE '' END AS title,
    text || ' ' || CASE WHEN doc_id % 4 = 0 THEN coalesce(b.stock_code, '') ELSE '' END || ' 123456789' AS content,
    CASE WHEN doc_id % 5 = 0 THEN ' ' || lower(a.stock_code) WHEN doc_id % 11 = 0 THEN substring(b.stock_code, 1, 6) END AS code,
    'file' || (doc_id % 3) AS source_file, doc_id, a.stock_name AS name_a, b.stock_name AS name_b,
    a.stock_code AS code_a, b.stock_code AS code_b
  FROM documents
  LEFT JOIN named a ON doc_id % (SELECT count(*) FROM supplier) = a.k LEFT JOIN named b ON (doc_id * 7 + 3) % (SELECT count(*) FROM supplier) = b.k)""",
    ("named",),
)
define(
    "named",
    f"""named AS (SELECT s_suppkey AS k, stock_code, stock_name FROM supplier JOIN basic ON stock_code = {code_sql('s_suppkey')})""",
    ("basic",),
)
define(
    "days",
    "days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE isodow(l_shipdate) <= 5)",
)
# explicit codes, six-digit runs, names in the title: kind, place, code
define(
    "matched",
    """texts AS (SELECT *, title || chr(10) || content AS news_text FROM raw_news),
explicit AS (SELECT doc_id, 0 AS kind, 0 AS place, CASE
    WHEN regexp_matches(upper(trim(code)), '[0-9]{6}\\.(SH|SZ|BJ)$') THEN regexp_extract(upper(trim(code)), '([0-9]{6}\\.(SH|SZ|BJ))$', 1)
    WHEN length(regexp_replace(code, '[^0-9]', '', 'g')) >= 6 THEN right(regexp_replace(code, '[^0-9]', '', 'g'), 6)
    ELSE nullif(trim(code), '') END AS stock_code FROM texts),
listed AS (SELECT left(stock_code, 6) AS digits, max(stock_code) AS stock_code FROM basic
    WHERE regexp_full_match(stock_code, '[0-9]{6}\\.(SH|SZ|BJ)') GROUP BY 1),
runs AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(news_text, '[0-9]+'), lambda r: length(r) = 6)) AS digits,
    generate_subscripts(list_filter(regexp_extract_all(news_text, '[0-9]+'), lambda r: length(r) = 6), 1) - 1 AS place FROM texts),
aliases AS (SELECT stock_name AS alias, min(stock_code) AS stock_code FROM basic GROUP BY 1),
hits AS (SELECT doc_id, unnest(regexp_extract_all(title, '(\\*ST)?Supplier#[0-9]{9}(退)?')) AS alias,
    generate_subscripts(regexp_extract_all(title, '(\\*ST)?Supplier#[0-9]{9}(退)?'), 1) AS place FROM texts),
found AS (SELECT doc_id, kind, place, stock_code FROM explicit WHERE stock_code IS NOT NULL
    UNION ALL SELECT doc_id, 1, place, stock_code FROM runs JOIN listed USING (digits)
    UNION ALL SELECT doc_id, 2, place, stock_code FROM hits JOIN aliases USING (alias)),
matched AS (SELECT t.*, coalesce(codes, []) AS codes FROM texts t LEFT JOIN (
    SELECT doc_id, list(stock_code ORDER BY kind, place) AS codes FROM (
      SELECT doc_id, stock_code, min(kind) AS kind, arg_min(place, kind * 1000000 + place) AS place FROM found GROUP BY ALL)
    GROUP BY 1) USING (doc_id))""",
    ("raw_news", "basic"),
)
define(
    "detail",
    """mapped AS (SELECT m.*, (SELECT min(day) FROM days WHERE day >=
      CAST(publish_time AS DATE) + CASE WHEN hour(publish_time) >= 15 THEN 1 ELSE 0 END) AS trade_date FROM matched m),
detail AS (SELECT * FROM mapped WHERE trade_date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY trade_date, publish_time, news_text ORDER BY source_file DESC) = 1)""",
    ("matched", "days"),
)


@query(
    "news_compose_text",
    sql("raw_news", "SELECT doc_id, sha256(title || chr(10) || content) AS text_hash, title AS title_text FROM raw_news"),
)
def news_compose_text(spark, sf):
    """Text of all text columns, and the title apart."""
    out = nw.compose_text(raw_news(spark, sf))
    return out.select("doc_id", F.sha2("news_text", 256).alias("text_hash"), "title_text")


@query(
    "alias_and_code_tables",
    sql(
        "basic",
        """SELECT 'alias' AS kind, stock_name AS term, min(stock_code) AS stock_code FROM basic GROUP BY 2
          UNION ALL SELECT 'code', left(stock_code, 6), max(stock_code) FROM basic
          WHERE regexp_full_match(stock_code, '[0-9]{6}\\.(SH|SZ|BJ)') GROUP BY 2""",
    ),
)
def alias_and_code_tables(spark, sf):
    """Names and six-digit codes that point to a full code."""
    names = tables.basic(spark, sf)
    alias = nw.alias_table(names).select(F.lit("alias").alias("kind"), F.col("alias").alias("term"), "stock_code")
    codes = nw.code_table(names).select(F.lit("code").alias("kind"), F.col("digits").alias("term"), "stock_code")
    return alias.unionByName(codes)


@query(
    "codes_in_text",
    sql("matched", "SELECT doc_id, CAST(place AS INTEGER) AS place, stock_code FROM runs JOIN listed USING (digits)"),
)
def codes_in_text(spark, sf):
    """Known six-digit codes in news texts."""
    texts = nw.compose_text(raw_news(spark, sf))
    return nw.codes_in_text(texts, nw.code_table(tables.basic(spark, sf)), "doc_id")


@query(
    "names_in_title",
    sql("matched", "SELECT doc_id, stock_code, count(*) AS hits FROM hits JOIN aliases USING (alias) GROUP BY ALL"),
)
def names_in_title(spark, sf):
    """Stock names in titles, longest first, not overlapping."""
    texts = nw.compose_text(raw_news(spark, sf))
    found = nw.names_in_text(texts, nw.alias_table(tables.basic(spark, sf)), "doc_id")
    return found.groupBy("doc_id", "stock_code").agg(F.count(F.lit(1)).alias("hits"))


@query(
    "news_matched_codes",
    sql(
        "matched",
        "SELECT doc_id, codes[1] AS stock_code, array_to_string(codes, '|') AS matched_stock_codes, "
        "CAST(len(codes) AS INTEGER) AS matched_stock_count FROM matched",
    ),
)
def news_matched_codes(spark, sf):
    """Explicit, written and named codes of each news row, in that order."""
    raw = raw_news(spark, sf).withColumnRenamed("code", "stock_code")
    out = nw.match_stocks(nw.compose_text(raw), tables.basic(spark, sf))
    return out.select("doc_id", "stock_code", "matched_stock_codes", "matched_stock_count")


@query(
    "forward_trade_day",
    sql("detail", "SELECT doc_id, publish_time, trade_date FROM mapped"),
)
def forward_trade_day_query(spark, sf):
    """First trading day a news row can be used on."""
    days = trading(spark, sf).select("trade_date")
    raw = raw_news(spark, sf).withColumn("publish_time", F.to_timestamp("datetime", "yyyyMMddHHmmss").cast("timestamp_ntz"))
    return forward_trade_day(raw, days, "publish_time").select("doc_id", "publish_time", "trade_date")


@query(
    "news_detail",
    sql(
        "detail",
        "SELECT trade_date, publish_time, sha256(news_text) AS text_hash, array_to_string(codes, '|') AS matched_stock_codes, "
        "source_file AS __source_file FROM detail",
    ),
)
def news_detail(spark, sf):
    """The whole news preparation: text, match, trade day, duplicates."""
    return detail(spark, sf).select(
        "trade_date", "publish_time", F.sha2("news_text", 256).alias("text_hash"), "matched_stock_codes", "__source_file"
    )


_SEPARATOR = "chr(10) || chr(10)"
_PART_BYTES = 20_000


def _joined_sql(keys: str, source: str) -> str:
    """Texts of each group in parts, as the operator makes them with parts of _PART_BYTES."""
    return f"""SELECT {keys}, part, sha256(string_agg(news_text, {_SEPARATOR} ORDER BY publish_time, sha256(news_text))) AS text_hash FROM (
      SELECT *, CAST(floor(coalesce(sum(octet_length(encode(news_text))) OVER (PARTITION BY {keys} ORDER BY publish_time, sha256(news_text)
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {_PART_BYTES}) AS INTEGER) AS part
      FROM (SELECT DISTINCT {keys}, publish_time, news_text FROM {source} WHERE news_text <> '')) GROUP BY {keys}, part"""


_FAN = 8


def _digest_sql(keys: str, source: str) -> str:
    """Digest per group of the node digests of its text digests, _FAN texts a node."""
    return f"""SELECT {keys}, sha256(string_agg(d, ',' ORDER BY node)) AS text_hash FROM (
      SELECT {keys}, place // {_FAN} AS node, sha256(string_agg(leaf, ',' ORDER BY place)) AS d FROM (
        SELECT {keys}, sha256(news_text) AS leaf, row_number() OVER (PARTITION BY {keys} ORDER BY publish_time, sha256(news_text)) - 1 AS place
        FROM (SELECT DISTINCT {keys}, publish_time, news_text FROM {source} WHERE news_text <> '')) GROUP BY ALL) GROUP BY ALL"""


@query(
    "market_news_daily",
    sql(
        "detail",
        f"""SELECT day AS trade_date, count(publish_time) AS market_news_count, max(publish_time) AS market_latest_publish_time,
          coalesce(min(text_hash), sha256('')) AS text_hash
          FROM days LEFT JOIN detail ON day = trade_date LEFT JOIN ({_digest_sql("trade_date", "detail")}) t ON t.trade_date = day GROUP BY 1""",
    ),
)
def market_news_daily(spark, sf):
    """News count, latest time and text for every trading day, also the empty ones."""
    out = nw.market_daily(detail(spark, sf), trading(spark, sf).select("trade_date"), fan=_FAN)
    text = F.col(nw.MARKET_DIGEST).alias("text_hash")
    return out.select("trade_date", "market_news_count", "market_latest_publish_time", text)


@query("market_news_texts", sql("detail", _joined_sql("trade_date", "detail")))
def market_news_texts(spark, sf):
    """All news texts of a day joined in order of time, in parts of bounded size."""
    news = stored(spark, sf)
    out = nw.joined_texts(detail(spark, sf, news), ["trade_date"], "text", _PART_BYTES, texts=news)
    return out.select("trade_date", "part", F.sha2("text", 256).alias("text_hash"))


define(
    "stock_news",
    """stock_news AS (SELECT DISTINCT unnest(codes) AS stock_code, trade_date, publish_time, news_text FROM detail)""",
    ("detail",),
)


@query("stock_news_texts", sql("stock_news", _joined_sql("stock_code, trade_date", "stock_news")))
def stock_news_texts(spark, sf):
    """All texts of a stock's day in order of time, in parts of bounded size."""
    news = stored(spark, sf)
    out = nw.joined_texts(nw.stock_rows(detail(spark, sf, news)), ["stock_code", "trade_date"], "text", _PART_BYTES, texts=news)
    return out.select("stock_code", "trade_date", "part", F.sha2("text", 256).alias("text_hash"))


@query(
    "stock_news_daily",
    sql(
        "stock_news",
        f"""SELECT stock_code || '_' || strftime(trade_date, '%Y-%m-%d') AS sample_id, stock_code, trade_date,
          count(*) AS news_count, max(publish_time) AS latest_publish_time, min(text_hash) AS text_hash
          FROM stock_news JOIN ({_digest_sql("stock_code, trade_date", "stock_news")}) USING (stock_code, trade_date) GROUP BY stock_code, trade_date""",
    ),
)
def stock_news_daily(spark, sf):
    """News count, latest time and text per stock and day."""
    out = nw.stock_daily(nw.stock_rows(detail(spark, sf)), fan=_FAN)
    columns = ("sample_id", "stock_code", "trade_date", "news_count", "latest_publish_time")
    return out.select(*columns, F.col(nw.STOCK_DIGEST).alias("text_hash"))


define(
    "monthly",
    """monthly AS (SELECT stock_code, date_trunc('month', trade_date)::DATE AS month, publish_time, news_text FROM stock_news)""",
    ("stock_news",),
)


@query(
    "attach_news_counts",
    sql(
        "samples monthly",
        f"""SELECT s.sample_id, coalesce(n.c, 0) AS news_count, coalesce(m.c, 0) AS market_news_count, n.text_hash FROM samples s
          LEFT JOIN (SELECT stock_code, month, count(*) AS c, min(text_hash) AS text_hash FROM monthly
              JOIN ({_digest_sql("stock_code, month", "monthly")}) USING (stock_code, month) GROUP BY ALL) n
            ON n.stock_code = s.stock_code AND n.month = s.trade_date
          LEFT JOIN (SELECT date_trunc('month', trade_date)::DATE AS month, count(*) AS c FROM detail GROUP BY ALL) m
            ON m.month = s.trade_date""",
    ),
)
def attach_news_counts_query(spark, sf):
    """Monthly news counts and texts joined to samples, counts zero where there is none."""
    month = F.trunc("trade_date", "month")
    news = detail(spark, sf)
    rows = nw.stock_rows(news).withColumn("trade_date", month)
    stock = nw.stock_daily(rows, fan=_FAN)
    market = news.withColumn("trade_date", month).groupBy("trade_date").agg(F.count(F.lit(1)).alias("market_news_count"))
    out = attach_news_counts(tables.samples(spark, sf), stock, market)
    return out.select("sample_id", "news_count", "market_news_count", F.col(nw.STOCK_DIGEST).alias("text_hash"))


# -- items ---------------------------------------------------------------------------

define(
    "items",
    r"""cleaned AS (SELECT publish_time, trade_date, source_file, codes,
    trim(regexp_replace(news_text, '[\s\x0b\x1c-\x1f\x{85}\pZ]+', ' ', 'g')) AS news_text FROM mapped),
hashed AS (SELECT *, sha256(news_text) AS news_text_hash, sha256(strftime(publish_time, '%Y-%m-%dT%H:%M:%S') || chr(10) || sha256(news_text)) AS news_id
    FROM cleaned WHERE news_text <> ''),
item_map AS (SELECT news_id, stock_code, min(place) AS place, min(publish_time) AS publish_time, min(trade_date) AS trade_date FROM (
    SELECT news_id, publish_time, trade_date, unnest(codes) AS stock_code, generate_subscripts(codes, 1) AS place FROM hashed)
    WHERE regexp_full_match(stock_code, '[0-9]{6}(\.(SH|SZ|BJ))?') GROUP BY ALL),
items AS (SELECT h.*, coalesce(matched_stock_codes, '') AS matched_stock_codes, coalesce(n, 0) AS matched_stock_count FROM (
    SELECT * FROM hashed QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY source_file, trade_date) = 1) h
  LEFT JOIN (SELECT news_id, string_agg(stock_code, '|' ORDER BY place, stock_code) AS matched_stock_codes, count(*) AS n
    FROM item_map GROUP BY 1) USING (news_id))""",
    ("detail",),
)


def undated(spark, sf) -> DataFrame:
    """News with matches and trade days, duplicates still in."""
    raw = raw_news(spark, sf).withColumn("publish_time", F.to_timestamp("datetime", "yyyyMMddHHmmss").cast("timestamp_ntz"))
    matched = nw.match_stocks(nw.compose_text(raw.withColumnRenamed("code", "stock_code")), tables.basic(spark, sf))
    return forward_trade_day(matched, trading(spark, sf).select("trade_date"), "publish_time")


@query(
    "news_items",
    sql(
        "items",
        "SELECT news_id, news_text_hash, publish_time, trade_date, source_file, matched_stock_codes, matched_stock_count FROM items",
    ),
)
def news_items(spark, sf):
    """One row per news id with the hash of its squeezed text."""
    items, _ = nw.news_items(undated(spark, sf))
    return items.select(
        "news_id", "news_text_hash", "publish_time", "trade_date", "source_file", "matched_stock_codes", "matched_stock_count"
    )


@query("news_stock_map", sql("items", "SELECT news_id, stock_code, publish_time, trade_date FROM item_map"))
def news_stock_map(spark, sf):
    """Pairs of news and stock."""
    return nw.news_items(undated(spark, sf))[1].select("news_id", "stock_code", "publish_time", "trade_date")


@query(
    "news_item_integrity",
    sql(
        "items",
        """SELECT (SELECT count(*) - count(DISTINCT news_id) FROM items) AS duplicate_ids,
          (SELECT count(*) FROM items WHERE publish_time IS NULL) AS missing_times,
          (SELECT count(*) FROM (SELECT DISTINCT news_id FROM item_map WHERE news_id NOT IN (
            SELECT news_id FROM items WHERE matched_stock_count < 3))) AS orphans, (SELECT count(*) FROM item_map) AS pairs""",
    ),
)
def news_item_integrity(spark, sf):
    """Counts behind the item checks; items with three or more stocks are left out to make orphans."""
    items, pairs = nw.news_items(undated(spark, sf))
    orphans = nw.orphan_ids(items.where(F.col("matched_stock_count") < 3), pairs)
    return items.agg(
        (F.count(F.lit(1)) - F.countDistinct("news_id")).alias("duplicate_ids"),
        F.count(F.when(F.col("publish_time").isNull(), 1)).alias("missing_times"),
    ).withColumns(
        {
            "orphans": orphans.agg(F.count(F.lit(1)).alias("n")).scalar(),
            "pairs": pairs.agg(F.count(F.lit(1)).alias("n")).scalar(),
        }
    )


@query(
    "news_items_between",
    sql("items", "SELECT news_id, publish_time FROM items WHERE publish_time BETWEEN TIMESTAMP '1997-03-01 12:00:00' AND TIMESTAMP '1999-06-30'"),
)
def news_items_between(spark, sf):
    """Items published in a range of times."""
    items, _ = nw.news_items(undated(spark, sf))
    return nw.items_between(items, "1997-03-01 12:00:00", "1999-06-30").select("news_id", "publish_time")


_GROUPS = {"couple": r"(?i)\band\b", "digits": r"[0-9]{6}\.(SH|SZ)", "french": r"eau|ère", "none": r"zzzzzz"}
_SINCE = ("1996-01-01", "1998-01-01", "2000-01-01")


@query(
    "news_keyword_coverage",
    sql(
        "detail",
        "SELECT theme_keyword_group, since, total_news, stock_news, total_news - stock_news AS market_news FROM ("
        + " UNION ALL ".join(
            f"SELECT '{g}' AS theme_keyword_group, '{s}' AS since, count(*) AS total_news, "
            f"count(*) FILTER (len(codes) > 0) AS stock_news FROM detail "
            f"WHERE regexp_matches(news_text, '{p}') AND trade_date >= DATE '{s}'"
            for g, p in _GROUPS.items()
            for s in _SINCE
        )
        + ")",
    ),
)
def news_keyword_coverage(spark, sf):
    """News per keyword group and start date, with and without matched stocks."""
    return nf.keyword_coverage(detail(spark, sf), _GROUPS, _SINCE)


# -- score answers -----------------------------------------------------------------------

_CENTS = "CAST(floor(value * 100 + 0.5) AS BIGINT)"
SCORE_SQL = {
    "sentiment_score": "(c % 201 - 100) / 101.0::DOUBLE",
    "impact_score": "(c % 101) / 103.0::DOUBLE",
    "risk_score": "(c % 97) / 97.0::DOUBLE",
    "relevance_score": "(c % 89) / 79.0::DOUBLE",
    "novelty_score": "(c % 83) / 83.0::DOUBLE",
}


def scored_events(spark, sf) -> DataFrame:
    """Events with five scores; some relevance scores are out of range."""
    c = F.floor(F.col("value") * 100 + 0.5).cast("bigint")
    return table(spark, sf, "events").withColumn("c", c).withColumns(
        {
            "sentiment_score": (F.col("c") % 201 - 100) / 101.0,
            "impact_score": (F.col("c") % 101) / 103.0,
            "risk_score": (F.col("c") % 97) / 97.0,
            "relevance_score": (F.col("c") % 89) / 79.0,
            "novelty_score": (F.col("c") % 83) / 83.0,
        }
    )


define(
    "scored_events",
    f"scored_events AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in SCORE_SQL.items())} FROM (SELECT *, {_CENTS} AS c FROM events))",
)


def _answer_fields() -> list:
    kinds = {"click": "Company", "view": "EARNINGS", "purchase": "risk", "signup": "geo-politics", "error": "policy"}
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()])
    horizon = F.when(F.col("c") % 50 == 0, "forever").when(F.col("c") % 3 == 0, "short")
    return [*es.SCORE_COLUMNS, kind.alias("event_type"), horizon.alias("horizon")]


@query(
    "score_answers",
    sql(
        "scored_events",
        f"""SELECT event_id, {rounded(['sentiment_score', 'impact_score', 'risk_score', 'relevance_score', 'novelty_score'])},
          CASE event_type WHEN 'click' THEN 'company' WHEN 'view' THEN 'earnings' WHEN 'error' THEN 'policy' ELSE 'other' END AS event_type,
          CASE WHEN c % 50 = 0 THEN 'forever' WHEN c % 3 = 0 THEN 'short' ELSE 'unknown' END AS horizon,
          nullif(concat_ws(';', CASE WHEN relevance_score > 1 THEN 'relevance_score' END, CASE WHEN c % 50 = 0 THEN 'horizon' END), '') AS reject_reason
          FROM scored_events""",
    ),
)
def score_answers(spark, sf):
    """JSON answers read and checked; some are wrapped in talk, some out of range."""
    body = F.to_json(F.struct(*_answer_fields()))
    events = scored_events(spark, sf)
    answers = events.select(
        "event_id", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Here it is: "), body, F.lit(" done"))).otherwise(body).alias("payload")
    )
    return tidy(es.read_answers(answers).drop("summary"))


@query(
    "score_batch_answers",
    sql(
        "scored_events",
        """SELECT batch, CAST(event_id % 4 AS INTEGER) AS id, round(impact_score, 6) + 0 AS impact_score FROM (
          SELECT *, event_id // 4 AS batch, count(*) OVER (PARTITION BY event_id // 4) AS n,
            max(CASE WHEN relevance_score > 1 OR c % 50 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_id // 4) AS bad FROM scored_events)
          WHERE bad = 0 AND n = 4 AND batch % 10 <> 3""",
    ),
)
def score_batch_answers(spark, sf):
    """Batches of four answers as list or keyed object; a batch with a wrong id or a bad item is dropped whole."""
    events = scored_events(spark, sf).withColumns(
        {"batch": F.floor(F.col("event_id") / 4), "id": (F.col("event_id") % 4).cast("int")}
    )
    ident = F.when(F.col("batch") % 10 == 3, F.col("id") + 1).otherwise(F.col("id"))
    one = events.select("batch", F.struct(ident.alias("id"), *_answer_fields()).alias("s"))
    grouped = one.groupBy("batch").agg(F.collect_list("s").alias("scores"))
    keyed = F.map_from_entries(F.transform("scores", lambda s: F.struct(s["id"].cast("string").alias("key"), s.alias("value"))))
    payload = F.when(F.col("batch") % 2 == 0, F.to_json(F.struct("scores"))).otherwise(F.to_json(F.struct(keyed.alias("scores"))))
    answers = grouped.select("batch", payload.alias("payload"), F.lit(4).alias("expected_count"))
    good = es.good_batches(es.read_batch_answers(answers), "batch")
    return tidy(good.select("batch", "id", "impact_score"))


def _score_table(spark, sf) -> DataFrame:
    e = scored_events(spark, sf)
    return e.select(
        F.sha2(F.concat_ws("|", "event_type", (F.col("c") % 500).cast("string")), 256).alias("news_text_hash"),
        F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string")).alias("llm_model"),
        F.lit("v1").alias("prompt_version"),
        "impact_score",
        F.col("ts").alias("scored_at"),
        "event_id",
    )


_SCORE_TABLE = """score_table AS (SELECT sha256(event_type || '|' || (c % 500)) AS news_text_hash, 'm' || (event_id % 2) AS llm_model,
  'v1' AS prompt_version, impact_score, ts AS scored_at, event_id FROM scored_events)"""


@query(
    "score_upsert",
    sql(
        "scored_events",
        """SELECT * REPLACE (round(impact_score, 6) + 0 AS impact_score) FROM score_table QUALIFY row_number() OVER (PARTITION BY news_text_hash, llm_model, prompt_version
          ORDER BY CASE WHEN scored_at < TIMESTAMP '2024-01-20' THEN 1 ELSE 0 END DESC, scored_at DESC) = 1""",
        _SCORE_TABLE,
    ),
)
def score_upsert(spark, sf):
    """New scores replace old ones per text, model and prompt version."""
    scores = _score_table(spark, sf)
    new = F.col("scored_at") < F.lit("2024-01-20").cast("timestamp_ntz")
    return tidy(es.upsert_scores(scores.where(~new), scores.where(new)))


@query(
    "score_pending",
    sql(
        "scored_events",
        """SELECT news_text_hash, min(event_id) AS news_id FROM score_table WHERE news_text_hash NOT IN (
          SELECT news_text_hash FROM score_table WHERE llm_model = 'm1' AND scored_at < TIMESTAMP '2024-01-06') GROUP BY 1 ORDER BY 2 LIMIT 300""",
        _SCORE_TABLE,
    ),
)
def score_pending(spark, sf):
    """The 300 oldest texts that one model has not scored yet."""
    scores = _score_table(spark, sf)
    items = scores.select("news_text_hash", F.col("event_id").alias("news_id"), F.col("scored_at").alias("publish_time"))
    done = scores.where(F.col("scored_at") < F.lit("2024-01-06").cast("timestamp_ntz"))
    return es.pending_items(items, done, "m1", "v1", 300).select("news_text_hash", "news_id")


# -- event windows -------------------------------------------------------------------------

EVENT_TYPES = {"click": "company", "view": "earnings", "purchase": "contract", "signup": "litigation"}


def event_tables(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored items, stock map and samples: users are stocks, errors are market news.

    Samples are all users on all days at 09:25, one decision clock.
    """
    e = scored_events(spark, sf)
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in EVENT_TYPES.items()],
                      F.when(F.col("c") % 2 == 0, "policy").otherwise("macro"))
    scored = e.select(
        F.col("event_id").alias("news_id"),
        F.col("ts").alias("publish_time"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("matched_stock_count"),
        F.col("user_id").cast("string").alias("stock_code"),
        *es.SCORE_COLUMNS,
        kind.alias("event_type"),
    )
    pairs = scored.where(F.col("matched_stock_count") > 0).select("news_id", "stock_code")
    users = spread(scored.select("stock_code").distinct(), "stock_code")
    days = scored.select(F.col("publish_time").cast("date").alias("day")).distinct()
    first, last = days.agg(F.min("day").alias("d")).scalar(), days.agg(F.max("day").alias("d")).scalar()
    grid = users.withColumn("day", F.explode(F.sequence(first, last)))
    samples = grid.select(
        sample_id("stock_code", "day").alias("sample_id"),
        "stock_code",
        (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(565))).alias("decision_ts"),
    )
    return scored, pairs, samples


define(
    "event_news",
    f"""event_news AS (SELECT event_id AS news_id, ts AS t, CAST(user_id AS VARCHAR) AS stock_code, event_type = 'error' AS market,
  sentiment_score AS s, impact_score AS i, risk_score AS r, relevance_score AS v, novelty_score AS n,
  CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_TYPES.items())} ELSE CASE WHEN c % 2 = 0 THEN 'policy' ELSE 'macro' END END AS kind
  FROM scored_events),
event_samples AS (SELECT stock_code || '_' || strftime(day, '%Y-%m-%d') AS sample_id, stock_code,
  CAST(day AS TIMESTAMP) + INTERVAL 565 MINUTE AS decision_ts FROM (SELECT DISTINCT stock_code FROM event_news),
  (SELECT CAST(unnest(generate_series(min(CAST(t AS DATE)), max(CAST(t AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day FROM event_news))""",
    ("scored_events",),
)


def window_sql(scope: str, types) -> str:
    head = f"news_{scope}"
    parts, names = [], []
    for w in nf.WINDOWS:
        inside = f"t > decision_ts - INTERVAL {w} DAY"
        f = f"FILTER ({inside})"
        rows = {
            "count": f"count(t) {f}",
            "high_impact_count": f"count(*) FILTER ({inside} AND i >= 0.7)",
            "negative_count": f"count(*) FILTER ({inside} AND s < 0)",
            "negative_high_impact_count": f"count(*) FILTER ({inside} AND s < 0 AND i >= 0.5)",
            "sentiment_mean": f"avg(s) {f}",
            "impact_mean": f"avg(i) {f}",
            "risk_mean": f"avg(r) {f}",
            "novelty_mean": f"avg(n) {f}",
            "impact_weighted_sentiment": f"sum(s * i) {f} / nullif(sum(i) {f}, 0)",
            "relevance_weighted_sentiment": f"sum(s * v) {f} / nullif(sum(v) {f}, 0)",
            "max_impact": f"max(i) {f}",
            "max_risk": f"max(r) {f}",
            "min_sentiment": f"min(s) {f}",
            "latest_sentiment": f"arg_max(s, t) {f}",
            "latest_impact": f"arg_max(i, t) {f}",
            "latest_risk": f"arg_max(r, t) {f}",
            "hours_since_latest": f"date_diff('microsecond', max(t) {f}, any_value(decision_ts)) / 3600000000.0::DOUBLE",
            **{f"{k}_count": f"count(*) FILTER ({inside} AND kind = '{k}')" for k in types},
        }
        for name, text in rows.items():
            full = f"{head}_{name}_{w}d"
            names.append(full)
            parts.append(f"({text})::DOUBLE AS {full}")
    if scope == "stock":
        join = "event_samples x LEFT JOIN event_news e ON e.stock_code = x.stock_code AND NOT market"
        keys, outer, key = "x.sample_id", "w", "sample_id"
    else:
        join = "(SELECT DISTINCT decision_ts FROM event_samples) x LEFT JOIN event_news e ON market"
        keys, outer, key = "x.decision_ts", "event_samples JOIN w USING (decision_ts)", "sample_id"
    body = (
        f"SELECT {keys}, {', '.join(parts)} FROM {join} AND t > decision_ts - INTERVAL 10 DAY AND t <= decision_ts GROUP BY 1"
    )
    return sql("event_news", f"SELECT {key}, {rounded(names)} FROM {outer}", f"w AS ({body})")


@query("news_stock_windows", window_sql("stock", nf.STOCK_TYPES))
def news_stock_windows(spark, sf):
    """Stock event factors over 1, 3, 5 and 10 days before 09:25."""
    scored, pairs, samples = event_tables(spark, sf)
    return tidy(nf.news_factors(samples, scored, "stock", pairs, check=False).output())


@query("news_market_windows", window_sql("market", nf.MARKET_TYPES))
def news_market_windows(spark, sf):
    """Market event factors over 1, 3, 5 and 10 days before 09:25."""
    scored, _, samples = event_tables(spark, sf)
    return tidy(nf.news_factors(samples, scored, "market", check=False).output())


@query(
    "net_event_score",
    sql(
        "event_news",
        f"SELECT sample_id, {rounded(['context_news_exact3', 'context_news_exact5'])} FROM ("
        "SELECT x.sample_id, avg(s * i * v - r) FILTER (t > decision_ts - INTERVAL 3 DAY) AS context_news_exact3, "
        "avg(s * i * v - r) AS context_news_exact5 FROM event_samples x LEFT JOIN event_news e ON e.stock_code = x.stock_code "
        "AND NOT market AND t > decision_ts - INTERVAL 5 DAY AND t <= decision_ts GROUP BY 1)",
    ),
)
def net_event_score(spark, sf):
    """Mean net event score over three and five days."""
    events, pairs, samples = event_tables(spark, sf)
    # every third text was never scored for novelty, which this score does not ask for
    novelty = F.when(F.col("news_id") % 3 != 0, F.col("novelty_score"))
    scores = events.select(F.sha2(F.col("news_id").cast("string"), 256).alias("news_text_hash"), *es.SCORE_COLUMNS, "event_type")
    scores = scores.join(events.select(F.sha2(F.col("news_id").cast("string"), 256).alias("news_text_hash"), novelty.alias("_n")), "news_text_hash")
    scores = scores.withColumn("novelty_score", F.col("_n")).drop("_n")
    items = events.drop(*es.SCORE_COLUMNS, "event_type").withColumn("news_text_hash", F.sha2(F.col("news_id").cast("string"), 256))
    scored = nf.scored_items(items, scores, ["risk_score"], nf.NET_SCORES)
    return tidy(nf.net_event_score(samples, scored, pairs))


@query(
    "scored_items",
    sql(
        "scored_events",
        """SELECT event_id AS news_id, round(impact_score, 6) + 0 AS impact_score, kind AS event_type FROM (
            SELECT event_id, sha256(event_type || '|' || (c % 500)) AS h FROM scored_events) JOIN (
            SELECT h, impact_score, kind FROM (SELECT sha256(event_type || '|' || (c % 500)) AS h, impact_score, event_id, risk_score, c,
              CASE WHEN c % 5 = 0 THEN 'other' ELSE 'company' END AS kind FROM scored_events WHERE value >= 10)
            QUALIFY row_number() OVER (PARTITION BY h ORDER BY event_id DESC) = 1) USING (h)""",
    ),
)
def scored_items(spark, sf):
    """Items joined to the last score of their text; a missing type becomes other."""
    e = scored_events(spark, sf).withColumn(
        "news_text_hash", F.sha2(F.concat_ws("|", "event_type", (F.col("c") % 500).cast("string")), 256)
    )
    items = e.select(F.col("event_id").alias("news_id"), "news_text_hash", F.col("ts").alias("publish_time"))
    scores = e.where(F.col("value") >= 10).withColumn("event_type", F.when(F.col("c") % 5 != 0, "company"))
    return tidy(nf.scored_items(items, scores, ["event_id"]).select("news_id", "impact_score", "event_type"))


@query(
    "norm_codes",
    sql(
        "basic",
        """SELECT stock_code, CASE WHEN length(left(stock_code, 6)) = 6 THEN stock_code END AS listed, left(stock_code, 6) AS digits,
          stock_name AS text FROM basic""",
    ),
)
def norm_codes(spark, sf):
    """Security codes from different spellings."""
    b = tables.basic(spark, sf)
    return b.select(
        "stock_code",
        norm_code(F.concat(F.lit("  x"), F.lower("stock_code"), F.lit(" "))).alias("listed"),
        norm_code(F.concat(F.lit("No. "), F.substring("stock_code", 1, 6), F.lit(" HK"))).alias("digits"),
        F.col("stock_name").alias("text"),
    )
