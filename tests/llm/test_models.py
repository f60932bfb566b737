"""Language, toxicity and personal data: held-out accuracy, brute force, edges."""

import math
import random
import re

import numpy as np
import pytest
from edge_rows import DOCS, no_docs, odd_docs, odd_texts  # noqa: F401
from pyspark.sql import functions as F

from tidepanel.llm import langid, pii, toxicity

SYLLABLES = {"aa": "la mo ri ta su ne".split(), "bb": "kra zed voz gir tuk hap".split(), "cc": "é çu ñe öl ïm ßa".split()}


def invented(language, n, rnd):
    parts = SYLLABLES[language]
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(240):
        g = list(SYLLABLES)[i % 3]
        rows.append((i, invented(g, rnd.randint(5, 60), rnd), g if i % 11 else None, "s", 0))
    return spark.createDataFrame(rows, DOCS)


def test_language_is_found(spark, languages, odd_docs, no_docs):
    model = langid.train(languages)
    assert model.languages == sorted(SYLLABLES)
    rnd = random.Random(2)
    new = [(i, invented(list(SYLLABLES)[i % 3], 12, rnd), None, None, None) for i in range(90)]
    rows = langid.identify(spark.createDataFrame(new, DOCS), model).select("doc_id", "language.*").collect()
    assert all(r.lang_pred == list(SYLLABLES)[r.doc_id % 3] and 0 <= r.score <= 1 and not r.rejected for r in rows)
    far = spark.createDataFrame([(1, "qxjw wjxq " * 60, None, None, None)], DOCS)
    assert langid.identify(far, model).first().language.rejected

    odd = langid.identify(odd_docs, model, name="answer").select("doc_id", "text", "answer.*").collect()
    assert len(odd) == odd_docs.count()
    for r in odd:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not letters)
        assert 0 <= r.score <= 1 and (letters or (r.score == 0 and r.rejected))
    assert len({(r.lang_pred, r.score) for r in odd if r.doc_id in (8, 9)}) == 1
    assert langid.identify(no_docs, model).count() == 0
    nothing = langid.train(no_docs)
    assert {r.language.lang_pred for r in langid.identify(odd_docs, nothing).collect()} == {"und"}


def test_probabilities_of_a_context_sum_to_one():
    rnd = random.Random(3)
    text = invented("aa", 300, rnd)
    codes = np.lib.stride_tricks.sliding_window_view(langid.characters(text), langid.ORDER)
    kinds, counts = np.unique(codes, axis=0, return_counts=True)
    model = langid.Model(["aa"], {"aa": (kinds.astype(np.uint32), counts)})
    alphabet = sorted({chr(c) for c in np.unique(kinds)})
    for context in ("", "la", "mori", "kkkk"):
        total = 0.0
        for c in alphabet:
            whole = np.concatenate([np.full(langid.ORDER - 1, 32, np.uint32), np.frombuffer((context + c).encode("utf-32-le"), np.uint32)])
            total += math.exp(_log_p(model, whole[-langid.ORDER :]))
        assert abs(total + math.exp(_log_p(model, np.append(whole[-langid.ORDER : -1], ord("%")).astype(np.uint32))) - 1) < 1e-4


def _log_p(model, gram):
    """Log-probability of the last character of a 5-gram, by the recursion written out."""
    hashes = langid.gram_hashes(gram)
    total = 0.0
    for n in range(langid.ORDER - 1, -1, -1):
        place = int(model.tables[n].find(hashes[n][-1:])[0])
        if place >= 0:
            return total + float(model.log_p[n][place, 0])
        if n:
            context = int(model.tables[n - 1].find(hashes[n - 1][-2:-1])[0])
            if context >= 0:
                total += float(model.log_rest[n - 1][context, 0])
    return total + float(model.unseen[0])


def test_stage_keeps_real_documents(spark, languages):
    docs = languages.withColumn("_language", F.lit("kept"))
    kept = langid.keep_identified(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == docs.count()


def marginals_by_enumeration(emission, transition):
    n = len(emission)
    weight = np.zeros((n, 2))
    for labels in range(1 << n):
        y = [(labels >> i) & 1 for i in range(n)]
        s = sum(e for e, v in zip(emission, y) if v) + sum(transition[a][b] for a, b in zip(y, y[1:]))
        for i, v in enumerate(y):
            weight[i, v] += math.exp(s)
    return np.log(weight[:, 1] / weight[:, 0])


def test_marginals_equal_enumeration(monkeypatch):
    rnd = np.random.default_rng(4)
    monkeypatch.setattr(toxicity, "BLOCK", 4)  # several blocks per text
    field = toxicity.Field(np.zeros(4), rnd.normal(0, 1, (2, 2)), 0.0)
    texts = [rnd.normal(0, 2, n) for n in (1, 3, 4, 5, 9, 12, 0)]
    for got, emission in zip(field.marginals(texts), texts):
        assert len(got) == len(emission)
        if len(emission):
            np.testing.assert_allclose(got, marginals_by_enumeration(emission, field.transition), atol=1e-9)


@pytest.fixture(scope="module")
def marked(spark):
    rnd = random.Random(5)
    plain = "".join
    rows, labels = [], []
    for i in range(900):
        words = invented(list(SYLLABLES)[i % 2], rnd.randint(10, 80), rnd).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                words.insert(rnd.randrange(len(words)), plain(["grok", rnd.choice(["", "er", "os"])]))
        rows.append((i, " ".join(words), None, None, 0))
        labels.append((i, 1, int(toxic)))
    labels += [(0, 1, 0), (5000, 1, 1), (1, None, None)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxic_documents_and_spans(spark, marked, odd_docs, no_docs):
    docs, labels = marked
    field = toxicity.train(docs.where("doc_id < 700"), labels.where("doc_id < 700"))
    rows = toxicity.score(docs.where("doc_id >= 700"), field).select("doc_id", "text", "toxicity.*").collect()
    right = sum(r.predicted == int(r.doc_id % 4 == 0) for r in rows)
    assert right >= 0.97 * len(rows)
    marked_words, found = 0, 0
    for r in rows:
        for a, b in (tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s):
            found += 1
            marked_words += "grok" in r.text[a:b]
    assert found >= 45 and marked_words >= 0.95 * found
    odd = toxicity.score(odd_docs, field, name="t").select("doc_id", "t.*").collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    assert len({r.score for r in odd if r.doc_id in (0, 1, 2)}) == 1
    assert toxicity.score(no_docs, field).count() == 0
    unlearnt = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r.toxicity.score for r in toxicity.score(odd_docs, unlearnt).collect()} == {0.0}


# -- personal data -----------------------------------------------------------------

FORMS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def brute_spans(text):
    out = []
    for kind, form in enumerate(FORMS):
        for m in form.finditer(text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2:
                doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
                if not 16 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_fixed_forms_equal_brute_force():
    rnd = random.Random(6)
    for _ in range(40_000):
        text = "".join(rnd.choice("1234567890. -+()@ab_%é") for _ in range(rnd.randint(0, 45)))
        assert pii.base_spans(text) == brute_spans(text), repr(text)
    texts = ["a@b.c_d@e.f", "4111 1111 1111 1111", "+1 (555) 010-9999.", "1.2.3.4.5.6.7.8", "x@y", "@a.b", "a@@b.c", "256.1.1.1"]
    for text in texts + [t or "" for t in odd_texts()] + ["1" * 50_000, "a" * 50_000 + "@", "1." * 20_000]:
        assert pii.base_spans(text) == brute_spans(text)


def test_spans_of_rows(spark, odd_docs, no_docs):
    rows = [(1, "mail a.b@c.org or call +1 555 010 9999, é 10.0.0.1", None, None, 0)] * 2
    df = odd_docs.select(*no_docs.columns).unionByName(spark.createDataFrame(rows, DOCS))
    got = pii.find(df.withColumns({"late": F.lit(1), "_read": F.lit(2), "k": F.lit(3)})).collect()
    assert len(got) == df.count()
    found = [r for r in got if r.n_email]
    assert len(found) == 2 and found[0] == found[1]
    assert found[0].spans == "email:5:14,ip:42:50,phone:23:38" and found[0].n_phone == found[0].n_ip == 1
    assert pii.find(no_docs).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(60):
        rows.append((i, f"please ring telephone +1 {rnd.randint(200, 999)} 555 {rnd.randint(1000, 9999)} today, room {i}4711", None, None, 0))
    rows.append((100, "please ring telephone 0171-555-88231 today, room 994711", None, None, 0))
    rows += [(200 + i, "please ring telephone 0171-555-88232 today", None, None, 0) for i in range(2)]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, DOCS)).collect()}
    text = rows[60][1]
    start = text.index("0171")
    assert got[100] == f"phone:{start}:{start + 14}"
    assert got[200] == got[201] == f"phone:{start}:{start + 14}"
    assert all(v.count(":") == 2 for k, v in got.items() if k < 100)
    # few seeds are no evidence
    few = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows[:3] + rows[60:61], DOCS)).collect()}
    assert few[100] == ""


def test_redaction(spark):
    rows = [(1, "é a.b@c.org, +1 555 010 9999 end", "en", "s", 0), (2, None, "en", "s", 5), (3, "plain 12", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id: r for r in pii.redact_documents(spark, docs, "").collect()}
    assert out[1].text == "é <EMAIL>, <PHONE> end" and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[2].n_chars == 5 and out[3].text == "plain 12"
    assert pii.redact_documents(spark, docs, "").columns == docs.columns


def test_a_rare_language_keeps_its_toxic_words(spark):
    rnd = random.Random(8)

    def text(lang, toxic):
        words = [f"{lang}{rnd.randrange(300)}w" for _ in range(40)]
        if toxic:
            words[rnd.randrange(1, 39)] = {"aa": "aavile", "bb": "bbgrim"}[lang]
        return " ".join(words)

    made = [(lang, toxic) for lang, n in (("aa", 600), ("bb", 30)) for toxic in (0, 1) for _ in range(n)]
    rows = [(i, text(lang, toxic), lang, "s", 0) for i, (lang, toxic) in enumerate(made)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, toxic) for i, (_, toxic) in enumerate(made)], "doc_id long, toxic int")
    field = toxicity.train(docs, labels, toxic_rows=60, clean_rows=60)
    fresh = spark.createDataFrame([(i, text("bb", i % 2), "bb", "s", 0) for i in range(60)], DOCS)
    got = toxicity.score(fresh, field).select("doc_id", "toxicity.predicted").collect()
    assert sum(r.predicted == r.doc_id % 2 for r in got) >= 57


def test_redaction_of_a_text_of_twenty_megabytes(spark):
    """100,000 spans in one text, in time that grows with its length."""
    one = "write to ann.bee@mail.example.org or see the page of today, which is long enough to fill two hundred characters of text with words "
    one += "x" * (205 - len(one)) + " "
    df = spark.createDataFrame([(1, one * 100_000), (2, None), (3, "")], "doc_id int, text string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {1: one.replace("ann.bee@mail.example.org", "<EMAIL>") * 100_000, 2: None, 3: ""}


def test_neighbour_words_are_whole():
    long = "w" * 500
    text = f"{long} second +44 171 555 8823 {long}z tail"
    start = text.index("+44")
    end = start + len("+44 171 555 8823")
    assert pii._patterns(text, start, end) == ["b second", f"bb {long} second", f"a {long}z", f"ba second {long}z"]
    assert pii._patterns("one two", 0, 7) == []
