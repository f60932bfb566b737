"""Near-duplicate groups and top-k search against brute force."""

import collections
import random
import re

import numpy as np
import pytest
from edge_rows import DOCS, no_docs  # noqa: F401
from pyspark.sql import functions as F

from tidepanel.llm import oddsketch, topk


def brute_sets(texts):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = max(1, len(words) - 4) if words else 0
        out.append({tuple(words[i : i + 5]) for i in range(n)})
    return out


def brute_components(rows):
    """(id, text) -> smallest id reachable, by position."""
    sets = brute_sets([t for _, t in rows])
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[root(i)] = root(j)
    lowest = collections.defaultdict(list)
    for i, (key, _) in enumerate(rows):
        lowest[root(i)].append(key)
    low = {r: min((k for k in keys if k is not None), default=None) for r, keys in lowest.items()}
    return [(len(sets[i]), low[root(i)], root(i)) for i in range(len(rows))]


def near_copies(seed=3):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, key = [], 100
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(30, 120))]
        for _ in range(rnd.randint(1, 14)):
            words = list(base)
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            text = " ".join(words)
            rows.append((key, text.upper() if rnd.random() < 0.2 else text))
            key -= 1 if rnd.random() < 0.5 else -3
    chain = [rnd.choice(vocabulary) for _ in range(100)]
    for i in range(12):  # each close to its neighbours only
        rows.append((1000 + i, " ".join(chain[i * 3 :] + [rnd.choice(vocabulary) for _ in range(i * 3)])))
    edges = [(7, None), (8, ""), (9, " \n"), (10, "a b"), (11, "a  b"), (12, "A B"), (13, "a b c"), (None, "a b"), (14, "a b"), (14, "a b")]
    return rows + edges


def test_components_equal_brute_force(spark):
    rows = near_copies()
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOCS)
    df = df.withColumns({c: F.lit(1) for c in ("sig", "root", "tid", "bands")}).repartition(5)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in oddsketch.near_duplicates(df).collect())
    want = collections.Counter()
    for (key, _), (n, low, _) in zip(rows, brute_components(rows)):
        low = low if n else key
        want[key, n, low, key == low] += 1
    assert got == want


def test_one_document_of_each_group_stays(spark):
    rows = near_copies(4)
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOCS)
    kept = oddsketch.keep_first(df)
    assert kept.columns == df.columns
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    sets = brute_sets([t for _, t in rows])
    parts = brute_components(rows)
    groups = {root for (n, _, root) in parts if n}
    assert len([k for k in kept if brute_sets([k[1]])[0]]) == len(groups)
    assert len([k for k in kept if not brute_sets([k[1]])[0]]) == sum(not s for s in sets)


def test_no_rows(spark, no_docs):
    assert oddsketch.near_duplicates(no_docs).count() == 0
    assert oddsketch.keep_first(no_docs).count() == 0


def test_across_components_joins_what_is_similar(spark):
    """Small blocks: buckets are split, and no link between different components is lost."""
    rnd = np.random.default_rng(5)
    names = [bytes([i // 256, i % 256]) * 8 for i in range(90)]
    base = rnd.integers(0, 1 << 62, 300, dtype=np.uint64)
    sets = []
    for i in range(len(names)):
        own = base.copy()
        n = int(rnd.integers(5, 60))
        own[rnd.choice(300, n, replace=False)] = rnd.integers(0, 1 << 62, n, dtype=np.uint64)
        sets.append(np.unique(own))
    samples = oddsketch.samples_of(sets)
    bits = oddsketch.odd_sketches(samples)
    bands = np.arange(1000, 1000 + 90 * oddsketch.BANDS).reshape(90, -1)
    bands[:, 3] = 1  # one bucket of all
    bands[45:70, 1] = 2
    root = [names[0] if i < 30 else names[50] if 50 <= i < 60 else n for i, n in enumerate(names)]
    members = spark.createDataFrame([(1, n) for n in names] + [(2, n) for n in names[45:70]], "key bigint, sig binary")
    table = spark.createDataFrame(list(zip(names, bits.tolist(), bands.tolist())), "sig binary, sketch array<bigint>, bands array<bigint>")
    hashes = spark.createDataFrame([(n, s.tobytes()) for n, s in zip(names, sets)], "sig binary, hashes binary")
    roots = spark.createDataFrame([(n, r) for n, r in zip(names, root) if r in (names[0], names[50])], "sig binary, root binary")
    limit = oddsketch.most_different_bits()
    found = oddsketch.across_components(members, table, roots, hashes, limit, block=8).collect()

    def parts(links):
        parent = {}

        def top(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[top(a)] = top(b)
        return {frozenset(n for n in names if top(n) == r) for r in {top(n) for n in names}}

    known = [(n, r) for n, r in zip(names, root)]
    similar = {
        (names[i], names[j]) for i in range(90) for j in range(i) if oddsketch._similar(sets[i], sets[j], oddsketch.THRESHOLD)
    }
    got = [(bytes(r.a), bytes(r.b)) for r in found]
    assert got and all(g in similar or g[::-1] in similar for g in got)
    assert parts(known + got) == parts(known + list(similar))
    assert len(parts(known + got)) < len(parts(known))


def test_sketches_estimate_similarity():
    rnd = np.random.default_rng(6)
    common = rnd.integers(0, 1 << 63, 850, dtype=np.uint64)
    a = np.unique(np.concatenate([common, rnd.integers(0, 1 << 63, 75, dtype=np.uint64)]))
    b = np.unique(np.concatenate([common, rnd.integers(0, 1 << 63, 75, dtype=np.uint64)]))
    samples = oddsketch.samples_of([a, b])
    bits = oddsketch.odd_sketches(samples).view(np.uint64)
    differ = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
    k, n = oddsketch.SAMPLES, oddsketch.SKETCH_BITS
    assert abs(1 + n / (4 * k) * np.log(1 - 2 * differ / n) - 0.85) < 0.1
    assert differ <= oddsketch.most_different_bits()


def brute_top(rows, k=5):
    out = []
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows]
    for a, (q, x) in enumerate(whole):
        if q % 50:
            continue
        found = []
        for b, (i, y) in enumerate(whole):
            if a != b:
                found.append((-sum(m * n for m, n in zip(x, y)), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["ties", "lengths", "copies", "large"])
def test_top_k_equals_brute_force(spark, kind):
    rnd = random.Random(kind)
    n = 220
    if kind == "ties":
        rows = [(i, [rnd.choice([0.0, 0.25, -0.25]) for _ in range(4)]) for i in range(n)]
    elif kind == "lengths":
        rows = [(i, [rnd.gauss(0, 1) * 2.0 ** (i % 9 - 4) for _ in range(6)]) for i in range(n)]
    elif kind == "copies":
        rows = [(i, [0.5, -0.5, 0.1] if i % 3 else [rnd.gauss(0, 1) for _ in range(3)]) for i in range(n)]
        rows.append((50, [0.5, -0.5, 0.1]))
    else:
        rows = [(i, [rnd.gauss(0, 1) * 1e5 for _ in range(3)]) for i in range(60)]
    odd = [(900, None), (950, [1.0, None]), (901, [float("nan"), 1.0]), (902, [float("inf")]), (None, [0.3, 0.2])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>")
    df = df.withColumns({"score": F.lit(1), "row": F.lit(2), "norm": F.lit(3)})
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows)


def test_high_thresholds_use_coordinates():
    """Near-parallel vectors: the coordinate lists must find what dense products find."""
    rnd = np.random.default_rng(8)
    axis = rnd.integers(0, 8, 400)
    data = np.rint(rnd.normal(0, 3, (400, 8)) + 200 * np.eye(8)[axis])
    ids = np.arange(400)
    block = topk.Block(400, 8, ids.tobytes(), ids.tobytes(), data.tobytes())
    queries = topk.Block(20, 8, ids[:20].tobytes(), ids[:20].tobytes(), data[:20].tobytes())
    start = np.sort(data[:20] @ data.T, axis=1)[:, -7] - 1.0
    best = topk.Best(queries, 5, start)
    assert (start / (queries.norm * block.norm.max()) >= topk.COORDINATE_FROM).any()
    best.meet(block)
    for i in range(20):
        score = data @ data[i]
        want = [j for j in np.lexsort((ids, -score)) if j != i][:5]
        assert best.id[best.q == i].tolist() == want


def test_top_k_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0
