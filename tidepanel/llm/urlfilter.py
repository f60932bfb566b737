"""URL verdicts: rules first, then a logistic regression on hashed character n-grams of host and path.

Everything is an expression or a stage of the DataFrame machine-learning API. The regression is trained from a small
labelled URL table (parameter ``most`` rows per verdict, by lowest hash, each host and path once). Where no such table is
given, the URLs that a rule decides are the labelled ones. N-grams come from the array of the letters of a text, so a long
URL costs time in proportion to its length.

Defined results: a null URL or one without ``://`` has empty host and path and fits no rule; repeated rows get equal
verdicts; with labels of one kind only the method gives that one, without labels ``allow``; an empty table gives an empty
table.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import read

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BUCKETS = 1 << 14

# Verdict, host, path
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    parts = "^([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(rest, parts, 1), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, parts, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    name: Column = F.lit(None).cast("string")
    verdict: Column = F.lit(None).cast("string")
    for what, own_host, own_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        name = F.when(fits, F.lit(own_host + own_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def grams(text: Column, mark: str) -> Column:
    """Distinct 3- and 4-letter runs of a text, its ends included."""
    letters = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")

    def run(n: int) -> Column:
        places = F.sequence(F.lit(1), F.size(letters) - (n - 1))
        some = F.transform(places, lambda i: F.concat(F.lit(mark), *[F.element_at(letters, i + k) for k in range(n)]))
        return F.when(F.size(letters) >= n, some).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(run(3), run(4)))


def features(df: DataFrame) -> DataFrame:
    """``df`` (with host and path) and its vector of hashed n-grams."""
    both = df.withColumn("_grams", F.concat(grams(F.col("host"), "h"), grams(F.col("path"), "p")))
    table = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=BUCKETS, binary=True)
    return table.transform(both).drop("_grams")


def train(labelled: DataFrame, most: int = 2000, strength: float = 0.002):
    """A model from rows (host, path, verdict); a verdict if there is one kind only, None without labels."""
    rows = labelled.filter(F.col("verdict").isin("allow", "block")).select("host", "path", "verdict").distinct()
    order = Window.partitionBy("verdict").orderBy(F.xxhash64("host", "path"), "host", "path")
    rows = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    # a few thousand rows, in one order, so that sums come out the same each time
    rows = rows.withColumn("label", (F.col("verdict") == "block").cast("double")).coalesce(1).sort("verdict", "place")
    rows = features(rows).select("label", "_features").cache()
    kinds = [r["label"] for r in rows.select("label").distinct().collect()]
    if len(kinds) == 2:
        model = LogisticRegression(
            featuresCol="_features", labelCol="label", predictionCol="_blocked", probabilityCol="_p",
            rawPredictionCol="_raw", regParam=strength, maxIter=60,
        ).fit(rows)
    else:
        model = ("block" if kinds[0] else "allow") if kinds else None
    rows.unpersist()
    return model


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of each row; ``labelled``: a small table (url, verdict)."""

    def cut(rows: DataFrame, url: str, *more: Column) -> DataFrame:
        host, path = host_and_path(F.col(url).cast("string"))
        return rows.select(*more, host.alias("host"), path.alias("path"))

    base = cut(df, url_col, F.col(id_col).alias("page_id"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": name, "decided": verdict})
    if labelled is None:
        known = base.filter(F.col("decided").isNotNull()).withColumnRenamed("decided", "verdict")
    else:
        known = cut(labelled, "url", F.col("verdict"))
    model = train(known)
    if model is None or isinstance(model, str):
        return base.select("page_id", "host", "path", "rule", F.coalesce("decided", F.lit(model or "allow")).alias("verdict"))
    out = model.transform(features(base))
    method = F.when(F.col("_blocked") == 1.0, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("decided", method).alias("verdict"))


def judge_pages(spark, sf: str) -> DataFrame:
    return judge(read(spark, sf, "pages").select("page_id", "url"))
