"""News: text, stock matching, trade days, daily aggregates, and the item tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalar import col
from tidepanel.functions.text import BLANKS, iso_time, norm_code, norm_label, norm_name, parse_time
from tidepanel.functions.text import sample_id, squeeze, text_hash, to_half_width
from tidepanel.operators.joins import forward_trade_day, on_calendar
from tidepanel.operators.keys import keep_first, keep_last, require_columns, require_unique
from tidepanel.operators.ordered import running_totals
from tidepanel.scale import freeze, null_safe_join, settled
from tidepanel.sources.readers import SOURCE_FILE, find_column

# Headers that name each part of a news row.
TIME_HEADERS = ("trade_date", "date", "datetime", "publish_time", "发布时间", "日期", "时间")
CODE_HEADERS = ("stock_code", "code", "ticker", "symbol", "ts_code", "wind_code", "证券代码", "股票代码")
NAME_HEADERS = ("stock_name", "name", "security_name", "证券简称", "股票简称", "简称")
TEXT_HEADERS = ("title", "headline", "content", "summary", "text", "标题", "内容", "摘要")
TITLE_HEADERS = ("title", "headline", "标题")
SHORTEST_ALIAS = 3
PART_BYTES = 8_000_000
SEPARATOR = "\n\n"
FAN = 1024  # text digests in a node of a digest tree
STOCK_TEXT, MARKET_TEXT = "news_text_concat", "market_news_text_concat"
STOCK_DIGEST, MARKET_DIGEST = "news_text_sha256", "market_news_text_sha256"
# of a stored news row: its number, and the digest and bytes of its text; whatever needs no more leaves the text where it lies
NEWS_ID, NEWS_SHA, NEWS_BYTES = MARKS = ("_news_id", "_news_sha", "_news_bytes")


def compose_text(news: DataFrame) -> DataFrame:
    """Add ``news_text`` from all text columns and ``title_text`` from the title columns."""

    def joined(headers) -> Column | None:
        wanted = {norm_label(h) for h in headers}
        parts = [c for c in news.columns if norm_label(c) in wanted]
        return F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in parts]) if parts else None

    text = joined(TEXT_HEADERS)
    if text is None:
        first = [f.name for f in news.schema.fields if f.dataType.typeName() == "string"][:2]
        text = F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in first])
    title = joined(TITLE_HEADERS)
    return news.withColumns({"news_text": text, "title_text": text if title is None else title})


def alias_table(names: DataFrame) -> DataFrame:
    """Alias to code: each name and its half-width form; the smallest code has it."""
    clean = names.select("stock_code", norm_name("stock_name").alias("_name")).dropna()
    forms = F.explode(F.array_distinct(F.array(F.col("_name"), to_half_width("_name"))))
    return (
        clean.select(forms.alias("alias"), "stock_code")
        .where(F.length("alias") >= SHORTEST_ALIAS)
        .groupBy("alias")
        .agg(F.min("stock_code").alias("stock_code"))
    )


def code_table(codes: DataFrame) -> DataFrame:
    """Six digits to full code; of two exchanges with the same digits the last counts."""
    listed = codes.select("stock_code").where(F.col("stock_code").rlike(r"^\d{6}\.(SH|SZ|BJ)$"))
    return listed.groupBy(F.substring("stock_code", 1, 6).alias("digits")).agg(F.max("stock_code").alias("stock_code"))


def codes_in_text(texts: DataFrame, codes: DataFrame, key: str = "_key", text: str = "news_text") -> DataFrame:
    """(key, place, stock_code) for each run of exactly six digits that is a known code."""
    runs = F.filter(F.regexp_extract_all(F.col(text), F.lit(r"\p{Nd}+"), F.lit(0)), lambda r: F.length(r) == 6)
    found = texts.select(key, F.posexplode(runs).alias("place", "digits"))
    return found.join(codes, "digits").select(key, "place", "stock_code")


def names_in_text(texts: DataFrame, aliases: DataFrame, key: str = "_key", text: str = "title_text") -> DataFrame:
    """(key, place, stock_code) for aliases in a text, leftmost and longest first, not overlapping.

    Every three letters of a text meet the distinct first three of the aliases, which know the lengths of their aliases; there
    the text is cut to each of these lengths, and a cut meets the aliases by equality. So a place costs as many rows as there
    are lengths, however many aliases begin alike, the text itself is never repeated, and neither the number of aliases nor of
    texts is limited.
    """
    n = SHORTEST_ALIAS
    letters = F.split(F.col(text), "")
    cut_to = lambda i, size: F.array_join(F.slice(F.col("_letters"), i, size), "")
    at = F.transform(
        F.sequence(F.lit(1), F.size("_letters") - (n - 1)),
        lambda i: F.struct(i.alias("place"), F.concat(*[F.element_at(F.col("_letters"), i + k) for k in range(n)]).alias("head")),
    )
    cut = texts.where(F.length(text) >= n).select(key, letters.alias("_letters"))
    places = cut.select(key, F.explode(at).alias("p")).select(key, "p.place", "p.head")
    heads = aliases.groupBy(F.substring("alias", 1, n).alias("head")).agg(F.collect_set(F.length("alias")).alias("sizes"))
    heads = freeze(heads, "heads")  # so that its size is known, and places are not shuffled for a small one
    near = places.join(heads, "head").select(key, "place", "sizes")
    # the places of one text, with the letters from each place on
    found = near.groupBy(key).agg(F.collect_list(F.struct("place", "sizes")).alias("_near"))
    whole = lambda h: F.filter(h["sizes"], lambda size: h["place"] + size - 1 <= F.size("_letters"))
    words = F.flatten(F.transform("_near", lambda h: F.transform(
        whole(h), lambda size: F.struct(h["place"].alias("place"), size.alias("n"), cut_to(h["place"], size).alias("alias"))
    )))
    named = cut.join(found, key).select(key, F.inline(words)).join(aliases, "alias")
    hits = named.groupBy(key, "place").agg(F.max(F.struct("n", "stock_code")).alias("hit"))
    # One text's own hits, in order; a hit that starts inside an accepted one is passed over.
    row = F.sort_array(F.collect_list(F.struct("place", F.col("hit.n").alias("n"), F.col("hit.stock_code").alias("code"))))
    start = F.struct(F.lit(1).alias("free"), F.array().cast("array<struct<place:int,code:string>>").alias("kept"))

    def accept(state, h):
        taken = F.struct(
            (h["place"] + h["n"]).cast("int").alias("free"),
            F.concat(state["kept"], F.array(F.struct(h["place"].alias("place"), h["code"].alias("code")))).alias("kept"),
        )
        return F.when(h["place"] >= state["free"], taken).otherwise(state)

    kept = hits.groupBy(key).agg(F.aggregate(row, start, accept, lambda s: s["kept"]).alias("kept"))
    return kept.select(key, F.explode("kept").alias("k")).select(
        key, F.col("k.place").alias("place"), F.col("k.code").alias("stock_code")
    )


def _digest(news: DataFrame) -> Column:
    """The text's digest, from its mark where there is one."""
    return F.lower(F.hex(NEWS_SHA)) if NEWS_SHA in news.columns else text_hash("news_text")


def _bytes(news: DataFrame) -> Column:
    return F.col(NEWS_BYTES) if NEWS_BYTES in news.columns else F.octet_length("news_text").cast("bigint")


def _keyed(news: DataFrame) -> DataFrame:
    """News with explicit code and name, and a ``_key`` that rows with the same code, name and text share."""
    explicit = norm_code("stock_code") if "stock_code" in news.columns else F.lit(None).cast("string")
    name = norm_name("stock_name") if "stock_name" in news.columns else F.lit(None).cast("string")
    work = news.withColumns({"_code": explicit, "_name": name})
    parts = [F.coalesce(c, F.lit("\u0001")) for c in (F.col("_code"), F.col("_name"), F.col("title_text"), _digest(news))]
    return work.withColumn("_key", F.sha2(F.concat_ws("\u0000", *parts), 256))


def _codes_by_key(work: DataFrame, names: DataFrame) -> DataFrame:
    """(_key, codes): the ordered distinct codes. Texts are searched where they are read, only titles and what is found moves."""
    aliases = alias_table(names)
    heads = work.select("_key", "_code", "_name", "title_text").dropDuplicates(["_key"])
    named = heads.join(
        aliases.select(F.col("alias").alias("_name"), F.col("stock_code").alias("_by_name")), "_name", "left"
    )
    given = named.select("_key", F.lit(0).alias("kind"), F.lit(0).alias("place"),
                         F.coalesce("_code", "_by_name").alias("stock_code"))
    coded = codes_in_text(work, code_table(names)).withColumn("kind", F.lit(1))
    titled = names_in_text(heads, aliases).withColumn("kind", F.lit(2))
    found = given.where(F.col("stock_code").isNotNull()).unionByName(coded).unionByName(titled)
    first = found.groupBy("_key", "stock_code").agg(F.min(F.struct("kind", "place")).alias("at"))
    return first.groupBy("_key").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "stock_code"))), lambda m: m["stock_code"]).alias("codes")
    )


def _with_codes(news: DataFrame) -> DataFrame:
    news = news.withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    return news.withColumns(
        {
            "stock_code": F.get("codes", F.lit(0)),
            "matched_stock_codes": F.array_join("codes", "|"),
            "matched_stock_count": F.size("codes"),
        }
    )


def match_stocks(news: DataFrame, names: DataFrame) -> DataFrame:
    """Add the ordered distinct codes of each news row: explicit, in the text, by name in the title.

    ``names`` holds stock_code and stock_name. Rows with the same code, name and
    text have the same codes.
    """
    work = _keyed(news)
    return _with_codes(work.join(_codes_by_key(work, names), "_key", "left")).drop("_key", "_code", "_name")


def stored_news(raw: DataFrame) -> DataFrame:
    """News rows under their own names with ``news_text`` and ``title_text``, stored once with the ``MARKS`` of each row.

    The texts are put together where they are read, and only there.
    """
    time = find_column(raw.columns, TIME_HEADERS)
    if time is None:
        raise ValueError("news has no publish time column")
    renames = {time: "publish_time"}
    for target, headers in (("stock_code", CODE_HEADERS), ("stock_name", NAME_HEADERS)):
        source = find_column(raw.columns, headers)
        if source:
            renames[source] = target
    news = raw.withColumnsRenamed(renames).withColumn("publish_time", parse_time("publish_time"))
    marks = (F.monotonically_increasing_id(), F.unhex(text_hash("news_text")), F.octet_length("news_text").cast("bigint"))
    return compose_text(freeze(compose_text(news).select(*news.columns, *[m.alias(n) for n, m in zip(MARKS, marks)]), "news"))


def prepare_news(raw: DataFrame, price: DataFrame, cutoff_hour: int = 15) -> DataFrame:
    """Detail table: text, matched codes and the trade day of each distinct news row.

    ``price`` gives the codes, names and trading days. News after the last
    trading day is dropped, of equal rows the last by source file stays. Rows are matched, dated and compared by their ``MARKS``;
    the rows that stay meet their texts in the end, if these are asked for. ``raw`` may be :func:`stored_news` already.
    """
    news = raw if NEWS_ID in raw.columns else stored_news(raw)
    names = price.select("stock_code", "stock_name" if "stock_name" in price.columns else F.lit(None).cast("string").alias("stock_name"))
    work = _keyed(news)
    slim = work.select(*MARKS, "publish_time", "_key", *[c for c in (SOURCE_FILE,) if c in news.columns])
    slim = slim.join(_codes_by_key(work, names.distinct()), "_key", "left")
    calendar = price.select(F.col("trade_date").cast("date").alias("day")).distinct()
    dated = forward_trade_day(slim, calendar, "publish_time", "trade_date", cutoff_hour)
    dated = _distinct_news(dated.where(F.col("trade_date").isNotNull()), ["trade_date", "publish_time"])
    kept = freeze(dated.select(NEWS_ID, "trade_date", "codes"), "detail")
    return _with_codes(news.drop("trade_date", "codes").join(kept, NEWS_ID))


def _distinct_news(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of rows with equal keys and text the last by source file; texts are compared by their hash."""
    work = rows.withColumn("_text", _digest(rows))
    order = [SOURCE_FILE] if SOURCE_FILE in rows.columns else ["_text"]
    return keep_last(work, [*keys, "_text"], order).drop("_text")


def market_daily(detail: DataFrame, calendar: DataFrame, part_bytes: int = PART_BYTES, fan: int = FAN) -> DataFrame:
    """Count, latest time and digest of all news of each trading day, also of days without any.

    The text itself is in the parts of :func:`joined_texts` under the same trade_date.
    """
    daily = _daily(detail, ["trade_date"], part_bytes, fan)
    daily = daily.select(
        "trade_date", F.col("n").alias("market_news_count"), F.col("latest").alias("market_latest_publish_time"),
        F.col("digest").alias(MARKET_DIGEST), F.col("parts").alias("market_text_parts"),
    )
    out = on_calendar(calendar, daily, ["market_news_count", "market_text_parts"])
    return out.withColumn(MARKET_DIGEST, F.coalesce(MARKET_DIGEST, F.sha2(F.lit(""), 256)))


def stock_rows(detail: DataFrame) -> DataFrame:
    """One row per news and matched stock."""
    rows = detail.select(
        F.explode("codes").alias("stock_code"),
        *[c for c in detail.columns if c not in ("codes", "stock_code", "matched_stock_codes", "matched_stock_count")],
    )
    return _distinct_news(rows, ["stock_code", "trade_date", "publish_time"])


def stock_daily(rows: DataFrame, part_bytes: int = PART_BYTES, fan: int = FAN) -> DataFrame:
    """Count, latest time and digest of all news per stock and day; the text is in the parts of :func:`joined_texts`."""
    daily = _daily(rows, ["stock_code", "trade_date"], part_bytes, fan)
    return daily.select(
        sample_id("stock_code", "trade_date").alias("sample_id"), "stock_code", "trade_date", F.col("n").alias("news_count"),
        F.col("latest").alias("latest_publish_time"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias(STOCK_DIGEST),
        F.coalesce("parts", F.lit(0)).alias("text_parts"),
    )


def _slim(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What places and digests need of each text: its time, its digest and its bytes."""
    return rows.select(*keys, "publish_time", _digest(rows).alias("_text"), _bytes(rows).alias("_bytes"))


def _daily(rows: DataFrame, keys: Sequence[str], part_bytes: int, fan: int) -> DataFrame:
    """Per group: ``n`` news, ``latest`` time, ``digest`` of the texts in order of time, and the number ``parts`` after its last part.

    The digest is a tree, so no task meets a group: texts have digests, ``fan`` neighbouring ones (joined by commas) make a
    node, and the nodes of a group its digest. No text is moved for it.
    """
    keys = list(keys)
    slim = settled(_slim(rows, keys), "news")
    counts = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("publish_time").alias("latest"))
    texts = slim.where(F.col("_bytes") > 0).distinct()
    placed = running_totals(texts, keys, ["publish_time", "_text"], {"_place": F.lit(1), "_begin": F.col("_bytes")})
    placed = placed.withColumn("_node", F.floor(F.col("_place") / fan))
    joined = lambda x, by: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, x))), lambda s: s[x]), ","), 256)
    nodes = placed.groupBy(*keys, "_node").agg(joined("_text", "_place").alias("_digest"), F.max("_begin").alias("_begin"))
    last = F.floor(F.max("_begin") / part_bytes).cast("int") + 1
    whole = nodes.groupBy(*keys).agg(joined("_digest", "_node").alias("digest"), last.alias("parts"))
    return null_safe_join(counts, whole, keys)


def joined_texts(
    rows: DataFrame, keys: Sequence[str], out: str, part_bytes: int = PART_BYTES, separator: str = SEPARATOR, texts: DataFrame | None = None
) -> DataFrame:
    """All texts of a group in order of time, as parts of about ``part_bytes`` each.

    A text belongs to the part in which it begins, so no part is longer than that by more than one text (and a long text may
    leave the numbers of parts unused). Places are found on time, digest and length alone, by ranges; the texts only meet
    inside their part. They are read from ``texts``, stored rows with the marks that ``rows`` have; without these the rows are stored.
    """
    keys = list(keys)
    if texts is None or NEWS_ID not in rows.columns:
        marks = (F.monotonically_increasing_id(), F.unhex(_digest(rows)), _bytes(rows))
        rows = texts = freeze(rows.select(*keys, "publish_time", "news_text", *[m.alias(n) for n, m in zip(MARKS, marks)]), "texts")
    slim = rows.where(F.col(NEWS_BYTES) > 0).groupBy(*keys, "publish_time", _digest(rows).alias("_text")).agg(
        F.min(NEWS_ID).alias(NEWS_ID), F.max(NEWS_BYTES).alias("_bytes")
    )
    slim = running_totals(slim, keys, ["publish_time", "_text"], {"_begin": F.col("_bytes")})
    slim = slim.select(*keys, "_begin", NEWS_ID, F.floor(F.col("_begin") / part_bytes).cast("int").alias("part"))
    placed = slim.join(texts.select(NEWS_ID, "news_text"), NEWS_ID)
    pieces = F.sort_array(F.collect_list(F.struct("_begin", "news_text")))
    return placed.groupBy(*keys, "part").agg(F.array_join(F.transform(pieces, lambda t: t["news_text"]), separator).alias(out))


def text_of(texts: DataFrame, text: str, **key) -> Iterator[str]:
    """The parts of one group's text in order, one at a time: ``"\\n\\n".join(text_of(parts, "news_text_concat", trade_date=day))``."""
    for name, value in key.items():
        texts = texts.where(F.col(name).eqNullSafe(F.lit(value)))
    for row in texts.orderBy("part").select(text).toLocalIterator():
        yield row[0]


# -- items ------------------------------------------------------------------------


def news_items(detail: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per news id, and the map from news to stocks.

    The id is a hash of the time and of the text's hash; text is compared with its
    white space squeezed, blank texts and missing times are dropped.
    """
    require_columns(detail, ("publish_time", "news_text"), "news")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in detail.columns else F.lit("")
    work = detail.select(
        F.col("publish_time").cast("timestamp_ntz").alias("publish_time"),
        (F.col("trade_date").cast("date") if "trade_date" in detail.columns else F.lit(None).cast("date")).alias("trade_date"),
        squeeze("news_text").alias("news_text"),
        (F.col(SOURCE_FILE) if SOURCE_FILE in detail.columns else F.lit(None).cast("string")).alias("source_file"),
        F.concat(text("matched_stock_codes"), F.lit("|"), text("stock_code")).alias("_codes"),
    ).where(F.col("publish_time").isNotNull() & (F.col("news_text") != ""))
    work = work.withColumn("news_text_hash", text_hash("news_text"))
    work = work.withColumn("news_id", text_hash(F.concat_ws("\n", iso_time("publish_time"), F.col("news_text_hash"))))
    work = settled(work, "items")  # items and pairs, and all that counts them, read it without matching again

    pairs = work.select(
        "news_id", "publish_time", "trade_date", F.posexplode(F.split("_codes", r"[|,，;；\s]+")).alias("place", "_raw")
    ).withColumn("stock_code", listed_code("_raw"))
    pairs = pairs.where(F.col("stock_code").isNotNull()).groupBy("news_id", "stock_code").agg(
        F.min("publish_time").alias("publish_time"), F.min("trade_date").alias("trade_date"), F.min("place").alias("place")
    )
    summary = pairs.groupBy("news_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("place", "stock_code"))), lambda p: p["stock_code"]), "|"
        ).alias("matched_stock_codes"),
        F.count(F.lit(1)).alias("matched_stock_count"),
    )
    items = keep_first(work.drop("_codes"), ["news_id"], ["source_file", "trade_date"]).join(summary, "news_id", "left")
    items = items.withColumns(
        {
            "matched_stock_codes": F.coalesce("matched_stock_codes", F.lit("")),
            "matched_stock_count": F.coalesce("matched_stock_count", F.lit(0)),
        }
    )
    return items, pairs.drop("place")


def listed_code(x: Column | str) -> Column:
    """``NNNNNN.EX``, ``NNNNNNEX`` or six digits; anything else is no code."""
    text = F.upper(F.regexp_replace(col(x), f"^{BLANKS}+|{BLANKS}+$", ""))
    full = F.regexp_replace(text, r"^(\d{6})\.?(SH|SZ|BJ)$", "$1.$2")
    return F.when(full.rlike(r"^\d{6}(\.(SH|SZ|BJ))?$"), full)


def check_items(items: DataFrame, stock_map: DataFrame) -> None:
    """Raise unless ids and pairs are unique, times present, and every mapped id known."""
    require_unique(items, ["news_id"], "news item")
    require_unique(stock_map, ["news_id", "stock_code"], "news-stock")
    if items.where(F.col("publish_time").isNull()).limit(1).count():
        raise ValueError("a news item has no publish time")
    orphans = orphan_ids(items, stock_map).limit(5).collect()
    if orphans:
        raise ValueError(f"unknown news ids in the stock map: {[r[0] for r in orphans]}")


def orphan_ids(items: DataFrame, stock_map: DataFrame) -> DataFrame:
    return stock_map.select("news_id").distinct().join(items, "news_id", "left_anti")


def items_between(items: DataFrame, start=None, end=None) -> DataFrame:
    """Items published in [start, end]."""
    work = items
    if start is not None:
        work = work.where(F.col("publish_time") >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        work = work.where(F.col("publish_time") <= F.lit(str(end)).cast("timestamp_ntz"))
    return work


__all__ = [
    "alias_table", "check_items", "code_table", "codes_in_text", "compose_text", "items_between",
    "joined_texts", "listed_code", "market_daily", "match_stocks", "names_in_text", "news_items", "orphan_ids",
    "prepare_news", "stock_daily", "stock_rows", "stored_news",
]
