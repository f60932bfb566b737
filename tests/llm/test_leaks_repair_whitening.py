"""Decontamination, conversation repair and whitening against brute force, and their edge rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from edge_rows import SMALL
from tidepanel.llm import conversation, decontaminate, whitening

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def windows(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_leaks(text, bench, n=10):
    w, hit, items = words(text), set(), set()
    for item, other in bench:
        for g in windows(other, n):
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    items.add(item)
    return len(w), len(hit), {i for i in items if i is not None}, bool(hit)


def odd_benchmark():
    long = " ".join(f"w{i}" for i in range(30))
    return [
        ("a", long), ("b", long), ("c", "Short  item!"), ("d", None), ("e", " .,; "), ("f", "Straße 漢字 café"), (None, "nameless words here"),
        ("g", "again " * 25), ("h", " ".join(f"W{i}" for i in range(20, 50))),
    ]


def odd_texts():
    long = " ".join(f"w{i}" for i in range(60))
    rng = random.Random(3)
    mixed = [" ".join(rng.choice(["w1", "w2", "short", "item", "again", "nameless", "words", "here", "."]) for _ in range(200)) for _ in range(20)]
    return [None, "", " ", "short item", "SHORT-item, short", "straße\n漢字 CAFé", "CAFÉ 漢字", "nameless words here", "w9 w10 w11", long, long.upper(), "again " * 9,
            "again " * 12, "x" * 3_000_000 + " short item", ("filler words " * 60000) + long, "short", "item", "short item", "short item", "é \x00short\x00item", *mixed]


@pytest.mark.parametrize("limit", [1 << 19, 8])
def test_leaks_agree_with_brute_force(spark, monkeypatch, limit):
    """In one set of windows and in many, with nulls, short items, repeated items and names that clash."""
    monkeypatch.setattr(decontaminate, "WINDOWS", limit)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 4 if limit == 8 else 4096)
    texts, bench = odd_texts(), odd_benchmark()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("leak_0", F.lit("kept")).repartition(3)
    found = decontaminate.find(docs, spark.createDataFrame(bench, "item_id string, text string"))
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(texts) and all(r.leak_0 == "kept" for r in got.values())
    for i, text in enumerate(texts):
        n, hit, items, any_hit = brute_leaks(text, bench) if len(text or "") < 2_000_000 else (3, 2, {"c"}, True)
        runs = got[i].leak.hit
        assert (got[i].leak.n_words, sum(r["words"] for r in runs), set(got[i].leak.items), bool(runs)) == (n, hit, items, any_hit), text
        assert all(a["first"] + a["words"] < b["first"] for a, b in zip(runs, runs[1:]))


def test_spans_and_documents_are_removed(spark):
    docs = spark.createDataFrame([(1, "Before. Short  ITEM! After"), (2, "clean text"), (3, None)], "doc_id int, text string")
    bench = spark.createDataFrame([("c", "short item")], "item_id string, text string")
    found = decontaminate.find(docs, bench)
    assert {r.doc_id: r.text for r in decontaminate.without_spans(found).collect()} == {1: "Before. ! After", 2: "clean text", 3: None}
    assert sorted(r.doc_id for r in decontaminate.without_documents(found).collect()) == [2, 3]


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id int, text string")
    none = spark.createDataFrame([], "item_id string, text string")
    assert [tuple(r.leak) for r in decontaminate.find(docs, none).collect()] == [(2, [], [], 7)]
    bench = spark.createDataFrame([("c", "short item")], "item_id string, text string")
    assert decontaminate.find(docs.limit(0), bench).collect() == []


# ---------------------------------------------------------------- conversations
def brute_repair(rows):
    """Cheapest (cost, letters) by extending every path, insertions included."""
    best = {("", 0): (0, "")}  # (pattern so far reduced to its state, row)
    queue = [(0, "", 0, "")]
    accepted = None
    import heapq

    done = set()
    while queue:
        cost, letters, i, place = heapq.heappop(queue)
        if (i, place) in done:
            continue
        done.add((i, place))
        if i == len(rows) and place in ("", "a"):
            accepted = (cost, letters)
            break
        after = {"": "u", "s": "u", "u": "a", "a": "u"}[place]
        heapq.heappush(queue, (cost + 5, letters + "I", i, after))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(queue, (cost + 2, letters + "D", i + 1, place))
            if fault in (conversation.SOUND, conversation.TRUNCATED):
                more = 5 if fault == conversation.TRUNCATED else 0
                if initial == after or (initial == "s" and place == ""):
                    heapq.heappush(queue, (cost + more, letters + "K", i + 1, initial))
                heapq.heappush(queue, (cost + more + 1, letters + "R", i + 1, after))
    assert best
    return accepted


def random_rows(rng, n):
    return [(rng.choice("uaauus?"), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(n)]


def test_search_is_cheapest_and_first_in_letter_order():
    rng = random.Random(1)
    for _ in range(1500):
        rows = random_rows(rng, rng.randint(0, 14))
        assert conversation.Search(rows, conversation.ACCEPTED).best(conversation.START) == brute_repair(rows), rows


def test_runs_put_together_give_the_whole_search():
    """Tables of short runs, joined in any grouping, route the same edits as one search."""
    rng = random.Random(2)
    for _ in range(150):
        rows = random_rows(rng, rng.randint(1, 24))
        cuts = sorted({0, len(rows), *(rng.randint(0, len(rows)) for _ in range(4))})
        runs = [rows[a:b] for a, b in itertools.pairwise(cuts)]
        tables = [conversation._table(r) for r in runs]
        cost, places = conversation._route([t[:2] for t in tables], conversation.START, conversation.ACCEPTED)
        entered = [conversation.START, *places[:-1]]
        letters = "".join(t[2][4 * a + b] for t, a, b in zip(tables, entered, places))
        assert (cost, letters) == brute_repair(rows)
        if len(tables) > 2:
            part = conversation._joined(tables[0][:2], tables[1][:2])
            assert conversation._route([part, *[t[:2] for t in tables[2:]]], conversation.START, conversation.ACCEPTED)[0] == cost


def expected(rows):
    """The contract's columns for the rows of one conversation, read plainly."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    cost, letters = brute_repair([(r[1][:1], f) for r, f in zip(rows, faults)])
    out, i = [], 0
    for e in letters:
        if e in "KR":
            system = e == "K" and not out and rows[i][1][:1] == "s"
            turns = len([o for o in out if o[0][:1] in "ua"])
            out.append(rows[i][1:] if e == "K" or system else (("user", "assistant")[turns % 2], rows[i][2]))
        i += e != "I"
    turns = {r[0] for r in rows} - {None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    text = "\n".join(f"{a}:{b}" for a, b in out)
    return (gaps, *[faults.count(f) for f in (1, 2, 3)], sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256(text.encode()).hexdigest())


def talk(rng, conv, n):
    roles = ["user", "assistant", "system", "tool", ""]
    out = []
    for t in range(n):
        role = rng.choice(roles) if rng.random() < 0.2 else ("user", "assistant")[t % 2]
        text = rng.choice(["Yes.", "no", " ", "Why?", f"line {t}\nmore {t}.", f"open {t}", "é漢!\t"]) if rng.random() < 0.5 else f"text {t}."
        turn = None if rng.random() < 0.05 else t + (rng.random() < 0.1) * 3
        out.append((conv, turn, role, text))
    return out


@pytest.mark.parametrize("run, chunk", [(32, 1024), (4, 2)])
def test_conversations_agree_with_brute_force(spark, monkeypatch, run, chunk):
    """Short and long ones, a null id, nulls, ties, repeated rows, one conversation with half of all rows, clashing names."""
    monkeypatch.setattr(conversation, "RUN", run)
    monkeypatch.setattr(conversation, "CHUNK", chunk)
    rng = random.Random(run)
    rows = [r for c in range(40) for r in talk(rng, c, rng.randint(1, 9))] + talk(rng, 77, 220) + talk(rng, None, 45)
    rows += [(90, 1, None, None), (90, None, "user", None), (91, 3, "user", "Same."), (91, 3, "user", "Same."), (92, 5, "system", "Only.")]
    rows += [(93, i, "user", "Hot.") for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string").withColumns({"at": F.lit("x"), "first": F.lit(1), "conv": F.lit(2)})
    found, edits = conversation.repair(df.repartition(5))
    got = {r.conv: tuple(r[c] for c in (*conversation.COUNTS, "audit", "repaired_sha256")) for r in found.collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {c: expected(r) for c, r in by.items()}
    assert {r.edit for r in edits.collect()} <= {"D", "K", "R"}


def test_absent_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (2, 0, "user", "Hi.")], "conv_id int, turn long, role string, text string")
    found, _ = conversation.repair(df, absent=F.col("conv_id") == 2)
    nothing = hashlib.sha256(b"").hexdigest()
    got = {r.conv: (r.cost, r.audit, r.repaired_sha256) for r in found.collect()}
    assert got == {1: (2, "D", nothing), 2: (0, "", nothing)}
    assert conversation.repair(df.limit(0))[0].collect() == []


# ---------------------------------------------------------------- whitening
def check_whitening(spark, df, x):
    model = whitening.fit(df)
    x = x + whitening.OFFSET
    n, total = len(x), x.sum(0)
    z = x - total / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    kept = int((values > 1e-12 * values[0]).sum()) if values[0] > 0 else 0
    assert model.n == n and model.components.shape[1] == kept
    rows = model.transform(df).collect()
    assert len(rows) == n
    if kept:
        assert np.allclose(model.values, values[:kept], rtol=1e-10, atol=1e-6 * values[0]) and model.identity_error < 1e-8
        white = np.array([r.whitening.whitened for r in rows])
        assert np.abs(white.T @ white / n - np.eye(kept)).max() < 1e-6
    deviation = sorted(int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total))) for row in x)
    assert sorted(r.whitening.deviation for r in rows) == deviation
    return model


def test_whitening_of_given_vectors(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    x = np.floor(1024 * np.array([r.embedding for r in df.collect()], float))
    model = check_whitening(spark, df, x)
    assert model.passes > 10 and max(model.residuals) < 1e-11 * model.values[0]  # 64 dimensions, a block of 32
    rows = whitening.whiten_embeddings(spark, SMALL).collect()
    assert len(rows) == 8 * len(x) and {r.component for r in rows} == set(range(1, 9))
    assert abs(sum({r.component: r.explained for r in rows}.values()) - model.values.sum() / model.trace) < 1e-12


def test_whitening_edges(spark):
    kind = "vec_id string, embedding array<float>, whitening string, size int"
    rows = [("a", [1.0, 2.0], "x", 1), (None, [3.0], "x", 1), ("a", [1.0, 2.0], "x", 1), ("n", None, "x", 1), ("m", [1.0, None], "x", 1),
            ("i", [float("inf"), 1.0], "x", 1), ("j", [float("nan"), 1.0], "x", 1), ("e", [], "x", 1)]
    df = spark.createDataFrame(rows, kind).repartition(3).drop("whitening").withColumn("data", F.lit("kept"))
    x = np.floor(1024 * np.array([[1, 2], [3, 0], [1, 2], [0, 0]], float))
    check_whitening(spark, df, x)
    same = spark.createDataFrame([("a", [0.5, 0.5], "x", 1)] * 5, kind).drop("whitening")
    assert whitening.fit(same).components.shape[1] == 0
    assert [r.whitening.whitened for r in whitening.fit(same).transform(same).collect()] == [[]] * 5
    assert whitening.fit(same).transform(same).first().whitening.deviation == 0
    none = whitening.fit(same.limit(0))
    assert none.n == 0 and none.transform(same.limit(0)).collect() == []
    far = spark.createDataFrame([("a", [1e15, 0.0], "x", 1), ("b", [0.0, 1.0], "x", 1)], "vec_id string, embedding array<double>, w string, size int")
    assert [r.whitening.deviation for r in whitening.fit(far).transform(far).collect()] == [None, None]


def test_low_rank_and_hot_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-200, 200, (300, 3)) @ rng.integers(-3, 4, (3, 80))
    x[:150] = x[0]  # half of the rows are one vector
    rows = [(i, [float(v) / 1024 for v in r]) for i, r in enumerate(x)]
    model = check_whitening(spark, spark.createDataFrame(rows, "vec_id int, embedding array<double>"), x.astype(float))
    assert model.components.shape[1] == 3
