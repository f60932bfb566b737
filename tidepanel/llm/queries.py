"""The registered queries of this subpackage."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import (
    bpe,
    conversation,
    decontaminate,
    flac,
    langid,
    oddsketch,
    packing,
    pii,
    sharding,
    topk,
    toxicity,
    urlfilter,
    whitening,
)
from tidepanel.llm.common import read
from tidepanel.registry.base import query


@query("op4_hierarchical_packing")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read(spark, sf, "documents"))


@query("op5_trie_bpe")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf, "documents"))


@query("op2_flac_media")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return flac.media_digests(read(spark, sf, "documents"))


NEAR_SQL = r"""WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] ELSE list_distinct(list_transform(range(0, greatest(len(w) - 4, 1)),
  lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END AS s FROM worded),
items AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM items a JOIN items b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x),
lowest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN lowest USING (doc_id)"""


@query("op10_odd_sketch_dedup", NEAR_SQL)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return oddsketch.near_duplicates(read(spark, sf, "documents")).drop("tid", "group_id")


@query("op1_kneser_ney_language")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return langid.held_out_languages(spark, sf)


@query("op9_crf_toxicity")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.held_out_toxicity(spark, sf)


TOP_SQL = """WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 5"""


@query("op3_norm_bucket_topk", TOP_SQL)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return topk.nearest_embeddings(spark, sf)


@query("op6_jump_hash_shards")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_documents(spark, sf)


@query("op7_url_regression")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return urlfilter.judge_pages(spark, sf)


@query("op8_contextual_pii")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_documents(spark, sf)


@query("op11_chebyshev_whitening")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten_embeddings(spark, sf)


LEAK_SQL = r"""WITH bench AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(0, greatest(len(w) - 9, 1)),
    lambda i: array_to_string(w[i + 1 : i + 10], ' '))) AS g FROM bench WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
places AS (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM docs CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (SELECT p.r, p.i, p.n, x.item_id FROM (SELECT r, i, n, array_to_string(w[i + 1 : i + n], ' ') AS g FROM places) p JOIN windows x USING (n, g)),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""


@query("op12_ngram_decontamination", LEAK_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.leaks_in_documents(spark, sf)


REPAIR_SQL = r"""WITH RECURSIVE keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
cases AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda s, b: list_reduce(list_concat([xor(s, b)], range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20 AS c FROM keyed),
damaged AS (SELECT conv_id, turn, CASE c WHEN 4 THEN 'user' ELSE role END AS role,
    CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE c WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM cases WHERE c <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
again AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM numbered),
faults AS (SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS f FROM again),
ids AS (SELECT DISTINCT conv_id FROM conversations),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank,
    count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY 1),
paths(conv_id, i, place, cost, audit, said) AS (SELECT conv_id, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]) FROM ids
  UNION ALL SELECT conv_id, i, place, cost, audit, said FROM (
    SELECT p.conv_id, f.i, e.place, p.cost + e.cost AS cost, p.audit || e.letter AS audit,
        CASE e.letter WHEN 'D' THEN p.said WHEN 'K' THEN list_append(p.said, f.role || ':' || f.text) ELSE list_append(p.said, CASE e.place WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text) END AS said
    FROM paths p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1,
    LATERAL (SELECT unnest([{'letter': 'D', 'cost': 2, 'place': p.place, 'ok': true},
        {'letter': 'K', 'cost': CASE f.f WHEN 't' THEN 5 ELSE 0 END, 'place': f.r, 'ok': f.f IN ('', 't') AND p.place || f.r IN ('s', 'u', 'su', 'ua', 'au')},
        {'letter': 'R', 'cost': CASE f.f WHEN 't' THEN 6 ELSE 1 END, 'place': CASE p.place WHEN 'u' THEN 'a' ELSE 'u' END, 'ok': f.f IN ('', 't')}], recursive := true)) e(letter, cost, place, ok)
    WHERE e.ok QUALIFY row_number() OVER (PARTITION BY p.conv_id, e.place ORDER BY p.cost + e.cost, p.audit || e.letter) = 1)),
best AS (SELECT p.conv_id, cost, audit, said FROM paths p LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id
    WHERE p.i = coalesce(c.n, 0) AND place IN ('', 'a') QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY cost, audit) = 1)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id"""


# no insertions in this SQL: a cheapest repair has none
@query("op13_ida_conversation_repair", REPAIR_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return conversation.repair_conversations(spark, sf)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)
