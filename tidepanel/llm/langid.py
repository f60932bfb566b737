"""Language of a text from interpolated Kneser-Ney character models.

Training counts 5-grams of characters per language with Spark, over a bounded sample of labelled texts (parameter
``sample_rows`` per language, the texts of lowest hash, copies once). From the counted 5-gram types all lower orders follow:
their counts are continuation counts. Every order is one sorted array of 64-bit gram hashes, shared by the
languages, with the interpolated log-probability in each language beside it, and the log back-off weight of the gram as a
context. A text is scored in arrays: one look-up per character in the highest order, and in lower orders only for the
characters not found there. The lowest cross-entropy per character wins.

A second bounded sample, not counted, calibrates: the chance that the answer is right, from the distance to the second
language, and per language how high the cross-entropy of real texts goes. What lies far above that is rejected.

Defined results: a null text and a text without a letter are ``und`` with score 0 and are rejected; ties go to the first
language by name; repeated rows give repeated answers; without any labelled text every answer is ``und``.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.bpe import in_chunks
from tidepanel.llm.common import crc32_of_id, free_name, read, slices, with_text_result

ORDER = 5
UNKNOWN = "und"
U = np.uint64
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U)
ROOM_NATS, ROOM_SHORT = 0.5, 8.0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for i in range(0x110000):
        table[i] = unicodedata.category(chr(i))[0] == "L"
    return table


def characters(text: str) -> np.ndarray:
    """Lower-cased letters with single spaces for all else, and four spaces before; empty if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.uint32)
    out = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    out = out[keep]
    return np.concatenate([np.full(ORDER - 1, 32, np.uint32), out])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def gram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For each order, the hash of the gram that ends at each column of ``codes`` (the last axis), from its end back."""
    total = np.zeros(codes.shape, U)
    out = []
    wide = codes.astype(U)
    for n in range(ORDER):
        if n:
            total[..., n:] += wide[..., :-n] * _MULTIPLIERS[n]
        else:
            total += wide * _MULTIPLIERS[0]
        out.append(_mix(total + U(n + 1)))
    return out


class Table:
    """A sorted hash array with an index over the leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(8, min(22, int(len(keys)).bit_length() + 1))
        lead = (keys >> U(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(lead, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.first).max(initial=0))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 if it is not there."""
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int32)
        place = self.first[(wanted >> U(64 - self.bits)).astype(np.int64)]
        np.minimum(place, len(self.keys) - 1, out=place)
        found = self.keys[place] == wanted
        out = np.where(found, place, -1).astype(np.int32)
        open_ = np.flatnonzero(~found)
        for step in range(1, self.longest):
            if not len(open_):
                break
            at = np.minimum(place[open_] + step, len(self.keys) - 1)
            hit = self.keys[at] == wanted[open_]
            out[open_[hit]] = at[hit]
            open_ = open_[~hit]
        return out


class Model:
    """Interpolated Kneser-Ney models of all languages over shared gram tables."""

    def __init__(self, languages: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        """``grams``: per language the distinct 5-grams as code points [n, 5] and their counts."""
        self.languages = languages
        self.tables: list[Table] = []
        self.log_p: list[np.ndarray] = []
        self.log_rest: list[np.ndarray] = []
        self.limit = np.full(len(languages), np.inf)
        self.slope = (0.0, 10.0)
        if not languages:
            return
        own = [self._levels(*grams[g]) for g in languages]
        alphabet = max(2, len({int(c) for g in languages for c in np.unique(grams[g][0])}) + 1)
        self.floor = -float(np.log(alphabet))
        self.unseen = np.array([np.log(lv[0]["rest_all"]) + self.floor for lv in own], np.float32)
        p_below: np.ndarray | None = None
        for n in range(ORDER):
            # grams of this order and the contexts of the next
            parts = [lv[n]["gram"] for lv in own] + ([lv[n + 1]["context"] for lv in own] if n + 1 < ORDER else [])
            codes = np.concatenate(parts)
            keys = gram_hashes(codes)[n][:, -1]
            keys, where = np.unique(keys, return_index=True)
            codes = codes[where]
            p = np.empty((len(keys), len(languages)))
            rest = np.zeros((len(keys), len(languages)))
            if n:
                below = self.tables[n - 1]
                suffix = below.find(gram_hashes(codes[:, 1:])[n - 1][:, -1])
                context = below.find(gram_hashes(codes[:, :-1])[n - 1][:, -1])
                low = np.where(suffix[:, None] >= 0, p_below[suffix], np.exp(self.floor))
            for k, lv in enumerate(own):
                at = np.searchsorted(keys, gram_hashes(lv[n]["gram"])[n][:, -1])
                if n == 0:
                    p[:, k] = lv[0]["rest_all"] * np.exp(self.floor)
                    p[at, k] += lv[0]["share"]
                else:
                    back = np.where(context >= 0, np.exp(self.log_rest[n - 1][context, k]), 1.0)
                    p[:, k] = back * low[:, k]
                    p[at, k] += lv[n]["share"]
                if n + 1 < ORDER and len(lv[n + 1]["context"]):
                    at = np.searchsorted(keys, gram_hashes(lv[n + 1]["context"])[n][:, -1])
                    rest[at, k] = np.log(lv[n + 1]["rest"])
            self.tables.append(Table(keys))
            self.log_p.append(np.log(p).astype(np.float32))
            self.log_rest.append(rest.astype(np.float32))
            p_below = p

    @staticmethod
    def _levels(codes: np.ndarray, counts: np.ndarray) -> list[dict]:
        """Per order: grams, their discounted share, contexts and the weight these leave to the order below."""
        levels: list[dict] = [{} for _ in range(ORDER)]
        for n in range(ORDER - 1, -1, -1):
            once, twice = int((counts == 1).sum()), int((counts == 2).sum())
            discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
            if n:
                context, where = np.unique(codes[:, :-1], axis=0, return_inverse=True)
                where = where.ravel()
                total = np.bincount(where, weights=counts)
                types = np.bincount(where)
                levels[n] = {
                    "gram": codes,
                    "share": np.maximum(counts - discount, 0) / total[where],
                    "context": context,
                    "rest": discount * types / total,
                }
                below, where = np.unique(codes[:, 1:], axis=0, return_inverse=True)
                codes, counts = below, np.bincount(where.ravel())
            else:
                total = max(1, counts.sum())
                levels[0] = {
                    "gram": codes,
                    "share": np.maximum(counts - discount, 0) / total,
                    "rest_all": discount * len(counts) / total if len(counts) else 1.0,
                }
        return levels

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each text in each language, and the number of characters."""
        parts = [characters(t) for t in texts]
        sizes = np.array([max(0, len(p) - ORDER + 1) for p in parts])
        out = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(sizes)
        if len(full):
            codes = np.concatenate([parts[i] for i in full])
            lengths = sizes[full] + ORDER - 1
            ends = np.cumsum(lengths)
            hashes = gram_hashes(codes)
            scored = np.ones(len(codes), bool)
            for j in range(ORDER - 1):
                scored[ends - lengths + j] = False
            at = np.flatnonzero(scored)
            log_p = np.zeros((len(at), len(self.languages)), np.float32)
            todo = np.arange(len(at))
            for n in range(ORDER - 1, -1, -1):
                place = self.tables[n].find(hashes[n][at[todo]])
                hit = place >= 0
                if hit.all():
                    log_p[todo] += self.log_p[n][place]
                    todo = todo[:0]
                    break
                log_p[todo[hit]] += self.log_p[n][place[hit]]
                todo = todo[~hit]
                if n:
                    context = self.tables[n - 1].find(hashes[n - 1][at[todo] - 1])
                    known = context >= 0
                    log_p[todo[known]] += self.log_rest[n - 1][context[known]]
            log_p[todo] += self.unseen
            sums = np.add.reduceat(log_p, np.cumsum(sizes[full]) - sizes[full], axis=0, dtype=np.float64)
            out[full] = -sums / sizes[full][:, None]
        return out, sizes

    def answers(self, texts: list) -> list[tuple]:
        """(language, score, nats per character, rejected) of each text."""
        out = []
        for run in in_chunks([t or "" for t in texts], 500_000):
            if not self.languages:
                out += [(UNKNOWN, 0.0, None, True)] * len(run)
                continue
            entropy, sizes = self.entropies(run)
            best = entropy.argmin(1)
            margin = _margin(entropy)
            chance = 1 / (1 + np.exp(-(self.slope[0] + self.slope[1] * margin)))
            for i, n in enumerate(sizes.tolist()):
                if not n:
                    out.append((UNKNOWN, 0.0, None, True))
                    continue
                own = float(entropy[i, best[i]])
                far = own > self.limit[best[i]] + ROOM_SHORT / np.sqrt(n)
                out.append((self.languages[best[i]], float(chance[i]), own, bool(far)))
        return out

    def calibrate(self, texts: list[str], truth: list[str]) -> None:
        """Fit the chance of a right answer to the margin, and how high real texts go."""
        rows = [(t, g) for t, g in zip(texts, truth) if g in self.languages]
        entropy = np.zeros((0, len(self.languages)))
        sizes = np.zeros(0, int)
        for run in in_chunks([t for t, _ in rows], 500_000):
            e, s = self.entropies(run)
            entropy, sizes = np.concatenate([entropy, e]), np.concatenate([sizes, s])
        some = sizes > 0
        if not some.any():
            return
        index = {g: k for k, g in enumerate(self.languages)}
        right = np.array([index[g] for _, g in rows])[some]
        entropy = entropy[some]
        correct = entropy.argmin(1) == right
        m = _margin(entropy)
        # softened targets keep the fit finite when all answers are right
        up = (correct.sum() + 1) / (correct.sum() + 2)
        down = 1 / ((~correct).sum() + 2)
        y = np.where(correct, up, down)
        x = np.stack([np.ones_like(m), m], 1)
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ w))
            h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            w = w - np.linalg.solve(h, x.T @ (p - y) + 1e-3 * w)
        self.slope = (float(w[0]), float(max(w[1], 0.0)))
        for k in range(len(self.languages)):
            own = entropy[right == k, k]
            if len(own):
                self.limit[k] = float(np.quantile(own, 0.999)) + ROOM_NATS


def _margin(entropy: np.ndarray) -> np.ndarray:
    if entropy.shape[1] < 2:
        return np.ones(len(entropy))
    low = np.partition(entropy, 1, axis=1)[:, :2]
    return low[:, 1] - low[:, 0]


def _count(batches):
    import pyarrow as pa

    for batch in (part for whole in batches for part in slices(whole)):
        languages, texts = (c.to_pylist() for c in batch.columns)
        grams: dict[str, list] = {}
        for g, t in zip(languages, texts):
            c = characters(t)
            if len(c):
                grams.setdefault(g, []).append(np.lib.stride_tricks.sliding_window_view(c, ORDER))
        for g, parts in grams.items():
            codes = np.concatenate(parts).astype("<u4")
            whole = np.ascontiguousarray(codes).view(f"V{4 * ORDER}").ravel()
            kinds, n = np.unique(whole, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([g] * len(kinds)), pa.array([k.tobytes() for k in kinds], pa.binary()), pa.array(n, pa.int64())],
                ["lang", "gram", "n"],
            )


def train(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = 1800,
    longest: int = 200_000,
) -> Model:
    """Models from a bounded sample of ``sample_rows`` texts per language: five in six are counted, the rest calibrate.

    Texts above ``longest`` characters and rows without text or language take no part in training.
    """
    rows = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest))
    rows = rows.withColumn("h", F.xxhash64("text"))
    keys = rows.select("lang", "h").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    keys = keys.withColumn("place", place).filter(F.col("place") <= sample_rows)
    # bounded by the parameters: a few thousand hashes per language
    chosen = rows.join(F.broadcast(keys), ["lang", "h"]).dropDuplicates(["lang", "h"]).repartition(16, "h")
    calibrates = F.pmod(F.xxhash64("h"), F.lit(6)) == 0
    counted = chosen.filter(~calibrates).select("lang", "text")
    counts = counted.mapInArrow(_count, "lang string, gram binary, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    grams = {}
    names = np.array(found.column("lang").to_pylist(), object)
    codes = np.frombuffer(b"".join(found.column("gram").to_pylist()), "<u4").reshape(-1, ORDER)
    numbers = found.column("n").to_numpy()
    for g in languages:
        own = names == g
        grams[g] = (codes[own], numbers[own])
    model = Model(languages, grams)
    if languages:
        rest = chosen.filter(calibrates).select("lang", "text").toArrow()
        model.calibrate(rest.column("text").to_pylist(), rest.column("lang").to_pylist())
    return model


SCHEMA = "lang_pred string, score double, nats double, rejected boolean"


def identify(df: DataFrame, model: Model, text_col: str = "text", name: str = "language") -> DataFrame:
    """``df`` with a struct column ``name``: language, score, cross-entropy per character, and whether it is rejected."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample the model is made of
    return with_text_result(df, text_col, lambda t: shared.value.answers(t), SCHEMA, name)


def is_learned(id_col: str, parts: int = 4, held: int = 2) -> Column:
    return crc32_of_id(id_col) % parts != held


def held_out_languages(spark, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    model = train(docs.filter(is_learned("doc_id")))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (~is_learned("doc_id")).alias("held_out"), "language.*")


def keep_identified(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is rejected go; all columns stay as they are."""
    name = free_name(docs, "_language")
    return identify(docs, train(docs), name=name).filter(~F.col(name)["rejected"]).drop(name)
