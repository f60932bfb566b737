"""Event scores: reading model answers, keeping the score table, and what is still to be scored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.scalar import col
from tidepanel.operators.keys import keep_first, keep_last

# Fixed values.
SCORE_COLUMNS = ("sentiment_score", "impact_score", "risk_score", "relevance_score", "novelty_score")
LOWEST = {"sentiment_score": -1.0}
EVENT_TYPES = (
    "company",
    "earnings",
    "policy",
    "macro",
    "rates",
    "fx",
    "geopolitics",
    "commodity",
    "shipping",
    "industry",
    "market",
    "litigation",
    "contract",
    "other",
)
HORIZONS = ("intraday", "short", "medium", "unknown")
OTHER = "other"
SCORE_KEY = ("news_text_hash", "llm_model", "prompt_version")

_FIELDS = ", ".join(f"{c} string" for c in (*SCORE_COLUMNS, "event_type", "horizon", "summary"))


def event_type(x: Column | str) -> Column:
    """One of the known types; unknown or missing ones (also ``risk``) are ``other``."""
    text = F.lower(F.trim(F.coalesce(col(x), F.lit(OTHER))))
    text = F.translate(text, "- ", "__")
    return F.when(text.isin(*EVENT_TYPES), text).otherwise(F.lit(OTHER))


def json_object(x: Column | str) -> Column:
    """The text if it is a JSON object, else the part from the first to the last brace."""
    x = F.trim(col(x))
    inner = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    return F.when(x.startswith("{") & x.endswith("}"), x).when(inner != "", inner)


def _checked(answers: DataFrame, fields: Column) -> DataFrame:
    """Typed score columns and the ``reject_reason`` of a bad answer."""
    work = answers.withColumn("_p", fields)
    reasons, scores = [], {}
    for c in SCORE_COLUMNS:
        value = F.col(f"_p.{c}").try_cast("double")
        scores[c] = value
        inside = value.between(LOWEST.get(c, 0.0), 1.0) & ~F.isnan(value)
        reasons.append(F.when(~F.coalesce(inside, F.lit(False)), c))
    horizon = F.coalesce(F.col("_p.horizon"), F.lit("unknown"))
    reasons.append(F.when(~horizon.isin(*HORIZONS), "horizon"))
    return work.withColumns(
        {
            **scores,
            "event_type": event_type("_p.event_type"),
            "horizon": horizon,
            "summary": F.coalesce("_p.summary", F.lit("")),
            "reject_reason": F.nullif(F.concat_ws(";", *reasons), F.lit("")),
        }
    ).drop("_p")


def read_answers(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """Scores of one answer per row.

    ``reject_reason`` names what is missing or out of range (NULL for a good row),
    so good rows and rejects are two filters over one pass.
    """
    return _checked(answers, F.from_json(json_object(payload), _FIELDS)).drop(payload)


def read_batch_answers(answers: DataFrame, payload: str = "payload", expected: str = "expected_count") -> DataFrame:
    """One row per scored item of batch answers.

    ``scores`` is a list of objects with ids or an object keyed by id. A batch
    whose ids are not exactly 0..n-1, or with any bad item, is rejected as a whole.
    """
    body = json_object(payload)
    listed = F.from_json(body, f"scores array<struct<id string, {_FIELDS}>>")["scores"]
    keyed = F.from_json(body, f"scores map<string, struct<{_FIELDS}>>")["scores"]
    names = [*SCORE_COLUMNS, "event_type", "horizon", "summary"]
    one = lambda ident, s: F.struct(ident.alias("id"), *[s[c].alias(c) for c in names])
    from_list = F.transform(listed, lambda s: one(s["id"], s))
    from_map = F.transform(F.map_entries(keyed), lambda e: one(e["key"], e["value"]))
    is_map = F.get_json_object(body, "$.scores").startswith("{")
    work = answers.withColumn("_items", F.when(is_map, from_map).otherwise(from_list))
    ids = F.transform("_items", lambda s: s["id"].try_cast("int"))
    wanted = F.transform(F.sequence(F.lit(1), F.col(expected)), lambda i: (i - 1).cast("int"))
    work = work.withColumn("_ids_ok", F.coalesce(F.sort_array(ids) == wanted, F.lit(False)))
    rows = work.select("*", F.explode_outer("_items").alias("_item")).withColumn("id", F.col("_item.id").try_cast("int"))
    rows = _checked(rows, F.col("_item")).drop(payload, "_items", "_item")
    return rows.withColumn(
        "reject_reason", F.when(F.col("_ids_ok"), F.col("reject_reason")).otherwise(F.lit("ids"))
    ).drop("_ids_ok")


def good_batches(rows: DataFrame, batch: str) -> DataFrame:
    """Items of the batches in which no item was rejected."""
    bad = rows.where(F.col("reject_reason").isNotNull()).select(batch).distinct()
    return rows.join(bad, batch, "left_anti").drop("reject_reason")


def upsert_scores(existing: DataFrame, fresh: DataFrame, key: Sequence[str] = SCORE_KEY) -> DataFrame:
    """Old and new scores, one per text, model and prompt version; a new one replaces an old one.

    ``scored_at`` orders the rows of one side.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return keep_last(both, key, ["_new", "scored_at"]).drop("_new")


def pending_items(
    items: DataFrame, scores: DataFrame, model: str, prompt_version: str, limit: int | None = None
) -> DataFrame:
    """Items whose text has no score of this model and prompt version; one per text, oldest first."""
    done = scores.where((F.col("llm_model") == model) & (F.col("prompt_version") == prompt_version))
    left = items.join(done.select("news_text_hash").distinct(), "news_text_hash", "left_anti")
    first = keep_first(left, ["news_text_hash"], ["publish_time", "news_id"])
    return first if limit is None else first.orderBy("publish_time", "news_id").limit(limit)
