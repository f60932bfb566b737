"""Sharding and URL verdicts against brute force; no Python in their plans."""

import collections
import random
import re
import zlib

from edge_rows import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from tidepanel.llm import sharding, urlfilter

MASK = (1 << 64) - 1


def jump(key, n):
    key &= MASK
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & MASK
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_the_loop(spark):
    rnd = random.Random(1)
    keys = [0, 1, -1, 2**63 - 1, -(2**63)] + [rnd.randrange(-(2**63), 2**63) for _ in range(500)] + list(range(500))
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for shards in (1, 2, 16, 100):
        low, grown = sharding.jump(F.col("k"), shards)
        for r in df.select("k", low.alias("a"), grown.alias("b")).collect():
            assert (r.a, r.b) == (jump(r.k, shards), jump(r.k, shards + 1))
            assert r.b in (r.a, shards)


def test_shards(spark, odd_docs, no_docs):
    out = sharding.shard(odd_docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = out.collect()
    texts = collections.Counter((r.doc_id, (r.text or "").encode()) for r in odd_docs.select("doc_id", "text").collect())
    assert len(rows) == sum(texts.values())
    want = collections.Counter()
    for (key, data), n in texts.items():
        want[key, len(data) + 1, zlib.crc32(data)] += n
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = collections.defaultdict(list)
    for r in rows:
        assert r.law == "key" and 0 <= r.shard < 16
        if r.doc_id is not None:
            assert (r.shard, r.grown_shard) == (jump(r.doc_id, 16), jump(r.doc_id, 17))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(no_docs).count() == 0


def test_shards_of_a_hot_row_and_text_keys(spark):
    hot = spark.range(3000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.shard(hot).select("shard", "slot").collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(3000))
    named = spark.createDataFrame([("a", "x"), ("b", None), (None, None)], "doc_id string, text string")
    assert sharding.shard(named).count() == 3


def brute_host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:at])
    rest = rest[at:]
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def brute_rule(host, path):
    best = None
    for verdict, own, start in urlfilter.RULES:
        if (host == own or host.endswith("." + own)) and path.startswith(start):
            if best is None or len(own + start) > len(best[0]):
                best = (own + start, verdict)
    return best or (None, None)


URLS = [
    None, "", "no scheme/com/", "http://", "http://com/", "http://Example.COM/en/a?x=/en/#y", "http://www.example.com/en/1",
    "http://a.www.example.com/en/", "http://example.com/de/", "http://notexample.com/en/", "http://xcom/", "http://net/es/",
    "http://a.net/es/x", "http://a.net/en/x", "http://a.net", "http://a.net?/es/", "http://a.org#/en/", "http://ÄB.net/fr/ä",
    "http://a.org/" + "x" * 20000, "x://y://com/", "http://u@example.com:80/en/", "http://com\n/x",
]


def test_rules_equal_brute_force(spark):
    rows = [(i, u, "kept") for i, u in enumerate(URLS)] + [(1, "", "kept")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string").withColumn("verdict", F.lit("x"))
    out = urlfilter.judge(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = brute_host_and_path(URLS[r.page_id])
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_regression_learns_from_a_small_table(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    known = [(f"http://{word()}.org/{'casino' if i % 2 else 'news'}/{word()}", "block" if i % 2 else "allow") for i in range(120)]
    new = [(i, f"http://{word()}.org/{'casino' if i % 2 else 'news'}/{word()}") for i in range(60)]
    labelled = spark.createDataFrame(known, "url string, verdict string")
    out = urlfilter.judge(spark.createDataFrame(new, "page_id bigint, url string"), rules=(), labelled=labelled)
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in out.collect())


def test_urls_without_labels(spark):
    df = spark.createDataFrame([(1, "http://a.org/x")], "page_id bigint, url string")
    assert [r.verdict for r in urlfilter.judge(df).collect()] == ["allow"]
    blocked = spark.createDataFrame([("http://b.org/", "block")], "url string, verdict string")
    assert [r.verdict for r in urlfilter.judge(df, labelled=blocked).collect()] == ["block"]
    assert urlfilter.judge(df.limit(0)).count() == 0
