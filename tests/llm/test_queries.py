"""The registered queries over whole tables, against brute force or held-out labels; the pipeline."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from edge_rows import SMALL
from test_models import brute_spans
from test_native import brute_host_and_path, brute_rule, jump
from test_pairs_and_search import brute_sets
from test_tokens_and_media import check_packing

import __spark_entry__ as entry
from tidepanel.llm import flac

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def queries():
    return {name.split("_")[0]: q for name, q in entry.queries().items() if name.startswith("op") or name == "pipeline"}


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    from tidepanel.llm.common import tokenizer_path

    return Tokenizer.from_file(tokenizer_path())


def test_all_are_registered(queries):
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} <= set(queries)


def is_held(key, parts, rest):
    return zlib.crc32(str(key).encode()) % parts == rest


def test_language(spark, queries):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    rows = queries["op1"](spark, LARGER).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == is_held(r.doc_id, 4, 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_media(spark, queries, texts):
    for r in queries["op2"](spark, SMALL).collect():
        n, payload = flac.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_sha256) == (n, hashlib.sha256(payload).hexdigest())


def test_top_k(spark, queries):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in table])
    whole = np.floor(256 * np.array([r.embedding for r in table], float)).astype(int)
    want = []
    for i in np.flatnonzero(ids % 50 == 0):
        score = whole @ whole[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:5]
        want += [(ids[i], k + 1, ids[j], score[j]) for k, j in enumerate(order)]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in queries["op3"](spark, SMALL).collect()]
    assert sorted(got) == sorted(want)


def test_packing(spark, queries, texts, library):
    check_packing(queries["op4"](spark, SMALL).collect(), list(texts.items()), library)


def test_encoding(spark, queries, texts, library):
    for r in queries["op5"](spark, SMALL).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_shards(spark, queries, texts):
    slots = collections.defaultdict(list)
    for r in queries["op6"](spark, SMALL).collect():
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.shard, r.grown_shard) == (
            len(data) + 1, zlib.crc32(data), jump(r.doc_id, 16), jump(r.doc_id, 17),
        )
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == len(texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_urls(spark, queries):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect()}
    rows = queries["op7"](spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path = brute_host_and_path(pages[r.page_id])
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)


def test_personal_data(spark, queries, texts):
    for r in queries["op8"](spark, SMALL).collect():
        spans = brute_spans(texts[r.doc_id] or "")
        kinds = ("email", "ip", "card", "phone")
        text = ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_toxicity(spark, queries):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries["op9"](spark, sf).collect()
    assert all(r.held_out == is_held(r.doc_id, 5, 0) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    yes, no = [s for s, t in held if t], [s for s, t in held if not t]
    area = np.mean([(a > b) + 0.5 * (a == b) for a in yes for b in no])
    assert area >= 0.95


def test_near_duplicates(spark, queries, texts):
    ids = list(texts)
    sets = brute_sets(texts.values())
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, key in enumerate(ids):
        low[root(i)] = min(key, low.get(root(i), key))
    want = {(key, len(sets[i]), low[root(i)], key == low[root(i)]) for i, key in enumerate(ids)}
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in queries["op10"](spark, SMALL).collect()}
    assert got == want


def test_pipeline_decisions_take_effect(spark, queries, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"{k}")
        stage(spark, docs, LARGER).write.parquet(path)
        kept = docs
        docs = spark.read.parquet(path)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
            if name == "private_data":
                assert docs.count() == kept.count()
                assert not any(brute_spans(r.text or "") for r in docs.select("text").collect())
            else:
                assert before * 0.5 < docs.count() <= kept.count()
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == ids


def test_pipeline_joins_near_duplicates_from_four_fifths(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = brute_sets(r.text for r in rows)
    holders, parent = collections.defaultdict(list), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    between = 0
    for i, own in enumerate(sets):
        common = collections.Counter(j for shingle in own for j in holders[shingle])
        for j, n in common.items():
            if 100 * n >= 80 * len(own | sets[j]):
                parent[root(i)] = root(j)
                between += 100 * n < 85 * len(own | sets[j])
        for shingle in own:
            holders[shingle].append(i)
    assert between  # pairs that a threshold of 0.85 leaves in
    want = {}
    for i, r in enumerate(rows):
        group = root(i) if sets[i] else (i,)
        want[group] = min(r.doc_id, want.get(group, r.doc_id))
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, LARGER).select("doc_id").collect()]
    assert sorted(kept) == sorted(want.values())


def test_entry_imports_without_the_subpackage():
    import subprocess
    import sys

    code = (
        "import sys\nsys.modules['tidepanel.llm'] = None\n"
        "import __spark_entry__ as e\nassert len(e.queries()) > 150 and 'pipeline' not in e.queries()"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rsplit("/", 1)[0], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-800:]
