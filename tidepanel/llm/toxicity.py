"""Toxic spans by a linear-chain conditional random field, learnt from documents marked toxic or not.

Labels are per document, the field needs labelled tokens. A bounded sample of labelled texts (parameters) is cut into
words, and each word into features: the word, what it begins with
(three to nine letters, where more follow), its last four letters. Spark counts in how
many different contexts (word before, word after) a feature occurs in toxic and in clean texts; counting contexts
instead of occurrences makes copies of one text count once. Features that clean texts practically lack, by a binomial bound
over all features tried, are markers; words of toxic texts with a marker are labelled toxic, all others clean.

The field has one weight per hashed feature and a weight per pair of neighbouring labels; it is fitted by gradient steps on
windows of the sample. To score a text, messages run over the whole of it: blocks of words are combined into 2 x 2
transfer matrices side by side, the blocks of a text are chained, then every word gets its marginal. A document's score
is a logistic function of its two most toxic words and its length, calibrated on a part of the sample with a field fitted to
the other part; the final field is fitted to the whole sample. Spans are the words of a marginal of at least a half.

Defined results: null and empty texts have the score of a text without words and no spans; repeated rows get equal
scores; a document with several labels counts as toxic if one says so; without labels of both kinds every score is 0.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.bpe import in_chunks
from tidepanel.llm.common import crc32_of_id, free_name, read, slices, with_text_result
from tidepanel.scale import freeze, null_safe_join

U = np.uint64
BITS = 18
WINDOW, BLOCK = 32, 64
PREFIXES, SUFFIX = (3, 4, 5, 6, 7, 8, 9), 4
KINDS = 2 + len(PREFIXES)
_STEP = 0x9E3779B97F4A7C15
_powers = (np.ones(1, U), np.ones(1, U))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point belongs to a word, and its lower case where that is one code point."""
    word, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        word[i] = unicodedata.category(chr(i))[0] in "LN"
        small = chr(i).lower()
        if len(small) == 1:
            lower[i] = ord(small)
    return word, lower


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _place_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_STEP, pow(_STEP, -1, 1 << 64)):
            steps = np.full(n, base, U)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers = tuple(made)
    return _powers


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, feature hashes [words, kinds]) of the words of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_word, lower = _tables()
    inside = is_word[points]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    power, back = _place_powers(len(points) + 1 if len(points) > 1 << 17 else 1 << 17)
    total = np.zeros(len(points) + 1, U)
    np.cumsum(_mix(lower[points].astype(U)) * power[: len(points)], out=total[1:])

    def piece(a, b, kind):
        return _mix((total[b] - total[a]) * back[a] + U(kind))

    columns = [piece(start, end, 1)]
    # a beginning counts only where the word goes on; 0 stands for none
    columns += [np.where(end - start > k, piece(start, np.minimum(start + k, end), 10 + k), U(0)) for k in PREFIXES]
    columns.append(piece(np.maximum(end - SUFFIX, start), end, 3))
    return start, end, np.stack(columns, 1) if len(start) else np.zeros((0, KINDS), U)


def _index(features: np.ndarray) -> np.ndarray:
    return (features >> U(64 - BITS)).astype(np.int32)


class Field:
    """Weights of the field and of the document score."""

    def __init__(self, weights: np.ndarray, transition: np.ndarray, bias: float):
        self.weights, self.transition, self.bias = weights, transition, bias
        self.document: np.ndarray | None = None

    def marginals(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Log-odds of the toxic label of every word of each text."""
        sizes = [len(e) for e in emissions]
        counts = [-(-n // BLOCK) for n in sizes]
        total = sum(counts)
        if not total:
            return [np.zeros(0) for _ in emissions]
        grid = np.zeros((total, BLOCK))
        live = np.zeros((total, BLOCK), bool)
        at = 0
        for e, n, c in zip(emissions, sizes, counts):
            grid[at : at + c].ravel()[:n] = e
            live[at : at + c].ravel()[:n] = True
            at += c
        t = np.exp(self.transition)
        potential = np.exp(np.clip(grid, -50, 50))
        first = np.cumsum([0, *counts[:-1]])
        forward = self._pass(potential, live, t, first, counts, False)
        backward = self._pass(potential, live, t, first, counts, True)
        odds = np.log(np.maximum(forward, 1e-300)) + np.clip(grid, -50, 50) + np.log(np.maximum(backward, 1e-300))
        return [odds[f : f + c].ravel()[:n] for f, c, n in zip(first.tolist(), counts, sizes)]

    @staticmethod
    def _pass(potential, live, t, first, counts, back: bool) -> np.ndarray:
        """Ratio (toxic to clean) of the messages that reach every word from its left, or its right; its own emission not in."""
        rows, width = potential.shape
        steps = range(width - 1, -1, -1) if back else range(width)
        if back:
            t = t.T
        # block matrices, built step by step: a message ratio r that enters leaves as (c + d r) / (a + b r)
        m = np.zeros((4, rows))
        m[0] = m[3] = 1.0
        for i in steps:
            a, b, c, d = m[0], m[1], m[2] * potential[:, i], m[3] * potential[:, i]
            new = np.stack(
                [t[0, 0] * a + t[1, 0] * c, t[0, 0] * b + t[1, 0] * d, t[0, 1] * a + t[1, 1] * c, t[0, 1] * b + t[1, 1] * d]
            )
            new /= new.max(0)
            m = np.where(live[:, i], new, m)
        # chain the blocks of each text, all texts side by side
        incoming = np.ones(rows)
        counts = np.asarray(counts)
        first = np.asarray(first)
        order = np.argsort(-counts, kind="stable")
        ratio = np.ones(len(counts))
        for k in range(int(counts.max())):
            own = order[: int(np.searchsorted(-counts[order], -k, side="left"))]
            block = first[own] + (counts[own] - 1 - k if back else k)
            incoming[block] = ratio[own]
            a, b, c, d = m[:, block]
            ratio[own] = (c + d * ratio[own]) / (a + b * ratio[own])
        # and once more inside the blocks
        out = np.ones((rows, width))
        r = incoming
        for i in steps:
            out[:, i] = r
            e = r * potential[:, i]
            r = np.where(live[:, i], (t[0, 1] + t[1, 1] * e) / (t[0, 0] + t[1, 0] * e), r)
        return out

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.weights[_index(features)].sum(1) + self.bias

    def summaries(self, texts: list) -> list[tuple]:
        """(log-odds of the most toxic word, of the second, words, spans) of each text."""
        out = []
        for run in in_chunks([t or "" for t in texts], 500_000):
            cut = [words(t) for t in run]
            odds = self.marginals([self.emissions(f) for _, _, f in cut])
            for (start, end, _), o in zip(cut, odds):
                if not len(o):
                    out.append((-30.0, -30.0, 0, ""))
                    continue
                top = np.partition(o, -2)[-2:] if len(o) > 1 else np.array([-30.0, o[0]])
                toxic = o >= 0
                spans = []
                if toxic.any():
                    edge = np.diff(np.concatenate([[False], toxic, [False]]).astype(np.int8))
                    spans = [
                        f"{start[a]}:{end[b - 1]}" for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0))
                    ]
                out.append((float(top[1]), float(top[0]), len(o), ",".join(spans)))
        return out

    def scores(self, texts: list) -> list[tuple]:
        rows = self.summaries(texts)
        if self.document is None:
            return [(0.0, 0, "") for _ in rows]
        x = _document_features(np.array([r[:3] for r in rows], float).reshape(-1, 3))
        p = 1 / (1 + np.exp(-np.clip(x @ self.document, -50, 50)))
        return [(float(s), int(s >= 0.5), r[3]) for s, r in zip(p, rows)]


def _document_features(rows: np.ndarray) -> np.ndarray:
    # a second toxic word adds to the first; the lack of one takes nothing away
    top, second = np.clip(rows[:, 0], -12, 12), np.clip(rows[:, 1], 0, 12)
    return np.column_stack([np.ones(len(rows)), top, second, np.log1p(rows[:, 2])])


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * w)
        w = w - np.clip(step, -5, 5)
    return w


def _window_marginals(e: np.ndarray, t: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of label 1 per word, and the expected label pairs summed, of windows with odds ``e`` and pair weights ``t``."""
    n, width = e.shape
    # messages, normalised at every word
    alpha, beta = np.empty((width, n, 2)), np.ones((width, n, 2))
    alpha[0] = np.stack([np.ones(n), e[:, 0]], 1)
    alpha[0] /= alpha[0].sum(1, keepdims=True)
    for i in range(1, width):
        v = alpha[i - 1] @ t
        v[:, 1] *= e[:, i]
        v /= v.sum(1, keepdims=True)
        alpha[i] = np.where(live[:, i : i + 1], v, alpha[i - 1])
    for i in range(width - 2, -1, -1):
        v = beta[i + 1].copy()
        v[:, 1] *= e[:, i + 1]
        v = v @ t.T
        v /= v.sum(1, keepdims=True)
        beta[i] = np.where(live[:, i + 1 : i + 2], v, 1.0)
    both = alpha * beta
    p = (both[:, :, 1] / both.sum(2)).T * live
    pairs = np.zeros((2, 2))
    for i in range(width - 1):
        right = beta[i + 1].copy()
        right[:, 1] *= e[:, i + 1]
        joint = alpha[i][:, :, None] * t[None] * right[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        pairs += joint[live[:, i + 1]].sum(0)
    return p, pairs


def fit_field(index: np.ndarray, labels: np.ndarray, rounds: int = 80, rate: float = 0.25, penalty: float = 2e-5) -> Field:
    """Gradient steps on windows: feature places [windows, words, kinds] (-1: no word) and labels [windows, words]."""
    n, width = labels.shape
    weights, trans, bias = np.zeros(1 << BITS, np.float32), np.zeros((2, 2)), -2.0
    grown_w, grown_t, grown_b = np.full(1 << BITS, 1e-4), np.full((2, 2), 1e-4), 1e-4
    seen = np.zeros((2, 2))
    first = index[:, :, 0] >= 0
    for a in (0, 1):
        for b in (0, 1):
            seen[a, b] = ((labels[:, :-1] == a) & (labels[:, 1:] == b) & first[:, 1:]).sum()
    # some thousand windows at a time, so that only their messages are held
    runs = [slice(i, i + 2048) for i in range(0, n, 2048)]
    for _ in range(rounds):
        t = np.exp(trans)
        grad, grad_t, grad_b = penalty * weights.astype(np.float64), -seen, 0.0
        for r in runs:
            live = index[r, :, 0] >= 0
            place = np.maximum(index[r], 0)
            s = np.where(live, weights[place].sum(2, dtype=np.float64) + bias, 0.0)
            p, joint = _window_marginals(np.exp(np.clip(s, -40, 40)), t, live)
            error = (p - labels[r] * live) / n
            grad += np.bincount(place[live].ravel(), weights=np.repeat(error[live], KINDS), minlength=1 << BITS)
            grad_t = grad_t + joint
            grad_b += float(error.sum())
        grown_w += grad * grad
        weights -= (rate * grad / np.sqrt(grown_w)).astype(np.float32)
        grad_t = grad_t / n + 1e-4 * trans
        grown_t += grad_t * grad_t
        trans -= rate * grad_t / np.sqrt(grown_t)
        grown_b += grad_b * grad_b
        bias -= rate * grad_b / np.sqrt(grown_b)
    return Field(weights, trans, bias)


def _contexts(batches):
    """(feature, context, toxic) of every word, once per batch."""
    import pyarrow as pa

    for batch in (part for whole in batches for part in slices(whole, 64)):
        for toxic in (0, 1):
            parts = []
            for text, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if mark != toxic:
                    continue
                f = words(text)[2]
                if len(f):
                    whole = np.concatenate([[U(0)], f[:, 0], [U(0)]])
                    context = _mix(whole[:-2] * U(3) + whole[2:])
                    both = np.stack([f, np.broadcast_to(context[:, None], f.shape)], 2).reshape(-1, 2)
                    parts.append(both[both[:, 0] != 0])
            if parts:
                flat = np.concatenate(parts)
                order = np.unique(flat[:, 0] * U(_STEP) + flat[:, 1], return_index=True)[1]
                flat = flat[order].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy()), pa.array(np.full(len(flat), toxic, np.int32))],
                    ["f", "c", "toxic"],
                )


def _windows(markers: np.ndarray, per_text: int):
    """Windows of words around labelled words, and spread ones from clean texts."""

    def run(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in slices(whole)):
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = words(text)[2]
                marked = np.isin(f, markers).any(1) if len(markers) else np.zeros(len(f), bool)
                hits = np.flatnonzero(marked)
                if not len(f) or (toxic and not len(hits)):
                    continue
                spread = np.linspace(0, max(0, len(f) - WINDOW), per_text).astype(int).tolist()
                near = [max(0, h - WINDOW // 2) for h in hits[:: max(1, len(hits) // per_text)].tolist()][:per_text]
                for a in sorted({*near, *(spread if not toxic else spread[:1])}):
                    index = np.full((WINDOW, KINDS), -1, np.int32)
                    label = np.zeros(WINDOW, np.int8)
                    part = f[a : a + WINDOW]
                    index[: len(part)] = _index(part)
                    if toxic:
                        label[: len(part)] = marked[a : a + WINDOW]
                    out.append((index.tobytes(), label.tobytes()))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["index", "label"])

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    toxic_rows: int = 1500,
    clean_rows: int = 2500,
    calibration_share: float = 0.3,
    longest: int = 100_000,
    per_text: int = 6,
    strata: Sequence[str] = ("lang", "source"),
) -> Field:
    """A field from a bounded sample of labelled texts: at most ``toxic_rows`` and ``clean_rows``, copies once.

    The columns ``strata``, where ``docs`` has them, share the sample evenly: each value of the first takes its turn, inside it
    each of the second, so a rare language or source keeps its texts until all have as many. Texts above ``longest`` characters
    take no part in training.
    """
    marks = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("key"))
    marks = marks.agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    of = [F.col(f"`{c}`").cast("string").alias(f"s{i}") for i, c in enumerate(c for c in strata if c in docs.columns)]
    groups = [f"s{i}" for i in range(len(of))]
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"), *of)
    rows = rows.filter(F.col("text").isNotNull() & (F.length("text") <= longest)).withColumn("h", F.xxhash64("text"))
    first = F.min(F.struct("key", *groups)).alias("first")
    keys = rows.select("key", "h", *groups).join(marks, "key").groupBy("h").agg(F.max("toxic").alias("toxic"), first)
    keys = freeze(keys.select("h", "toxic", "first.*", F.lit(0).alias("place")), "labelled")
    for depth in range(len(groups), -1, -1):
        lead = F.shiftright("h", 56) if depth == len(groups) else F.floor(F.col("place") / 16)
        keys = _first_rows(keys.withColumn("lead", lead.cast("long")), ["toxic", *groups[:depth]], max(toxic_rows, clean_rows))
    keys = keys.select("h", "toxic", "key", "place")
    keys = keys.filter(F.col("place") <= F.when(F.col("toxic") == 1, toxic_rows).otherwise(clean_rows))
    # bounded by the parameters: a few thousand keys
    chosen = rows.drop(*groups).join(F.broadcast(keys), ["key", "h"]).dropDuplicates(["h"]).repartition(16, "h")
    chosen = chosen.withColumn("calibrates", F.pmod(F.xxhash64("h"), F.lit(1000)) < int(1000 * calibration_share))

    def summary(field: Field) -> tuple[np.ndarray, np.ndarray]:
        shared = docs.sparkSession.sparkContext.broadcast(field)  # bounded: a weight per hashed feature
        base = chosen.filter("calibrates").select("text", "toxic")
        schema = "top double, next double, words bigint, spans string"
        seen = with_text_result(base, "text", lambda t: shared.value.summaries(t), schema, "r")
        seen = seen.select("r.top", "r.next", "r.words", "toxic").toArrow()
        top, second, count, toxic = (c.to_numpy().astype(float) for c in seen.columns)
        shared.destroy()
        return _document_features(np.column_stack([top, second, count])), toxic

    part = _fit(chosen.filter(~F.col("calibrates")).select("text", "toxic"), per_text)
    if part is None:
        return nothing()
    x, y = summary(part)
    field = _fit(chosen.select("text", "toxic"), per_text) or part
    if len(y):
        field.document = _logistic(x, y, 0.05)
    return field


def _first_rows(keys: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group by (place, h), numbered as ``place``; ``lead`` grows with that order.

    Rows are counted per group and lead first. What is numbered are rows of equal lead, behind the rows of smaller ones, so no
    task meets a whole group.
    """
    counts = keys.groupBy(*by, "lead").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("lead")) - F.col("n")
    counts = counts.withColumn("before", before).filter(F.col("before") < limit).drop("n")
    near = null_safe_join(keys, counts, [*by, "lead"], "inner")
    turn = Window.partitionBy(*by, "lead").orderBy("place", "h")
    near = near.withColumn("next", F.col("before") + F.row_number().over(turn)).filter(F.col("next") <= limit)
    return freeze(near.withColumn("place", F.col("next")).drop("next", "before", "lead"), "sample")


def nothing() -> Field:
    """What is learnt from no labels, or from labels of one kind."""
    return Field(np.zeros(1 << BITS, np.float32), np.zeros((2, 2)), 0.0)


def _fit(rows: DataFrame, per_text: int) -> Field | None:
    """A field from labelled texts; None if none of them can be told by a marker."""
    counted = rows.mapInArrow(_contexts, "f bigint, c bigint, toxic int").distinct().groupBy("f")
    is_toxic = F.col("toxic") == 1
    counted = counted.agg(F.count(F.when(is_toxic, 1)).alias("t"), F.count(F.when(~is_toxic, 1)).alias("n"))
    # the features of toxic texts and the sums over all features, in one job
    counted = freeze(counted.groupBy("t", F.when(F.col("t") > 0, F.col("f")).alias("f")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")), "contexts")
    sums = counted.agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).first()
    if not sums["t"] or not sums["n"]:
        return None
    share = sums["t"] / (sums["t"] + sums["n"])
    rate = F.col("t") / (F.col("t") + F.col("n"))
    # logarithm of a bound on the chance of so many toxic contexts, over all features tried
    surprise = F.col("t") * F.log(rate / share)
    surprise += F.when(F.col("n") > 0, F.col("n") * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    found = counted.filter((F.col("t") > 0) & (rate >= 0.9) & (surprise > float(np.log(sums["kinds"]))))
    markers = np.sort(found.select("f").toArrow().column("f").to_numpy().astype(np.int64).view(U))
    cut = rows.mapInArrow(_windows(markers, per_text), "index binary, label binary").toArrow()
    if not len(markers) or not cut.num_rows:
        return None
    index = _joined(cut, "index", np.int32).reshape(-1, WINDOW, KINDS)
    label = _joined(cut, "label", np.int8).reshape(-1, WINDOW)
    del cut
    return fit_field(index, label)


def _joined(table, name: str, kind) -> np.ndarray:
    """The bytes of a binary column of non-null values, as one array, straight from Arrow's buffers."""
    column = table.column(name)
    out = np.empty(sum(int(c.nbytes) for c in column.chunks), np.uint8)
    at = 0
    for chunk in column.chunks:
        _, ends, data = chunk.buffers()
        ends = np.frombuffer(ends, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        part = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if len(chunk) else out[:0]
        out[at : at + len(part)] = part
        at += len(part)
    return out[:at].view(kind)


SCHEMA = "score double, predicted int, spans string"


def score(df: DataFrame, field: Field, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """``df`` with a struct column ``name``: score, prediction, and toxic spans as ``start:end`` in code points."""
    shared = df.sparkSession.sparkContext.broadcast(field)  # bounded: a weight per hashed feature
    return with_text_result(df, text_col, lambda t: shared.value.scores(t), SCHEMA, name)


def is_learned(id_col: str, parts: int = 5, held: int = 0) -> Column:
    return crc32_of_id(id_col) % parts != held


def held_out_toxicity(spark, sf: str) -> DataFrame:
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    field = train(docs.filter(is_learned("doc_id")), labels.filter(is_learned("doc_id")))
    out = score(docs.select("doc_id", "text"), field)
    return out.select("doc_id", (~is_learned("doc_id")).alias("held_out"), "toxicity.*")


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go; all columns stay as they are."""
    labels = read(spark, sf_dir, "labels")
    field = train(docs.filter(is_learned("doc_id")), labels.filter(is_learned("doc_id")))
    name = free_name(docs, "_toxicity")
    return score(docs, field, name=name).filter(F.col(name)["predicted"] == 0).drop(name)
