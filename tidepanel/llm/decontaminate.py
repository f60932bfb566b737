"""Benchmark decontamination with a broadcast hash set of test n-grams.

Texts become words (lower-case letters, digits and all characters outside ASCII), a window is ``n`` words in a row; a
shorter benchmark item is one window of all its words. Spark cuts the items into pieces and gives each window a 64-bit hash. The
windows become a set: sorted hashes with a bitmap in front, the normalised words of every piece, and the items of each
window. A training text is hashed with the same rolling arithmetic, its windows are looked up, every hit is compared
word for word with the benchmark's, and the words under confirmed hits are marked. Nothing of a training text is shuffled.

A set holds at most ``WINDOWS`` windows and ``PIECE_BYTES`` bytes of words, which are counted before it is shared; a larger
benchmark becomes several sets, and the training texts pass once for each, with stage tables between.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no windows; items of equal text are
all named, an item without an id counts as a hit but is not named; equal rows give equal results; a benchmark without windows
leaves every document clean; an empty table gives an empty table. Texts are read in full, a megabyte of words at a time;
all other columns pass through untouched.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import free_name, read
from tidepanel.scale import freeze

N = 10
WINDOWS = 1 << 19
PIECE_BYTES = 1 << 25
PIECE_WORDS = 4096
CHUNK = 1 << 20
SLICE_BYTES = 1 << 21

_LETTER = np.zeros(256, bool)  # bytes of words after lower-casing; all bytes of characters outside ASCII
_LETTER[list(range(ord("0"), ord("9") + 1)) + list(range(ord("a"), ord("z") + 1)) + list(range(128, 256))] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_RADIX, _SPREAD, _STEP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))

PIECE = "item string, first bigint, windows int, size int, hashes binary, lengths binary, starts binary, ends binary, words binary"
RESULT = "n_words bigint, hit array<struct<first:bigint,words:bigint,start:bigint,end:bigint>>, items array<string>, size bigint"


class Words(NamedTuple):
    """Words of a text: lower-case bytes with one zero byte after each word, places there and in the text, and hashes."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text_start: np.ndarray
    text_end: np.ndarray
    hash: np.ndarray


def words_of(text: bytes) -> Words:
    raw = _LOWER[np.frombuffer(text, np.uint8)]
    letter = _LETTER[raw]
    edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    text_start, text_end = edge[0::2], edge[1::2]
    size = text_end - text_start
    start = np.cumsum(size + 1) - size - 1
    data = np.zeros(int((size + 1).sum()), np.uint8)
    after = np.zeros(len(raw) + 1, bool)
    after[text_end] = True
    keep = letter | after[:-1]
    kept = np.where(letter, raw, 0)[keep]
    data[: len(kept)] = kept  # the last word may have nothing after it
    hashed = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        # whole words of up to CHUNK bytes, or one longer word
        to = max(at + 1, int(np.searchsorted(start, start[at] + CHUNK)))
        low, high = int(start[at]), int(start[to - 1] + size[to - 1] + 1)
        place = np.arange(high - low) - np.repeat(start[at:to] - low, size[at:to] + 1)
        power = _powers(int(place.max()) + 1)
        hashed[at:to] = np.add.reduceat(data[low:high].astype(np.uint64) * power[place], start[at:to] - low)
        at = to
    hashed ^= hashed >> np.uint64(29)
    hashed *= _SPREAD
    hashed ^= hashed >> np.uint64(32)
    return Words(data, start, start + size, text_start, text_end, hashed)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _RADIX)
    out[0] = 1
    return np.multiply.accumulate(out)


def window_hashes(hashed: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words."""
    count = len(hashed) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = hashed[:count].copy()
    for k in range(1, length):
        out *= _STEP
        out += hashed[k : k + count]
    return out ^ (out >> np.uint64(31))


def _pieces(n: int):
    """Windows of benchmark items, in pieces of at most PIECE_WORDS windows."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = words_of((text.as_py() or "").encode())
                total = len(w.start)
                length = min(n, total)
                for at in range(0, total - length + 1 if total else 0, PIECE_WORDS):
                    to = min(at + PIECE_WORDS, total - length + 1)
                    low, high = int(w.start[at]), int(w.end[to + length - 2])
                    hashes = window_hashes(w.hash[at : to + length - 1], length)
                    numbers = [hashes, np.full(to - at, length), w.start[at:to] - low, w.end[at + length - 1 : to + length - 1] - low]
                    row = [item, at, to - at, high - low, *[x.tobytes() for x in numbers], w.data[low:high].tobytes()]
                    arrays = [pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5))]
                    yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in PIECE.split(", ")])

    return run


class WindowSet:
    """Windows of a benchmark: sorted hashes, a bitmap of their leading bits, words, and the items of each window."""

    def __init__(self, pieces: list):
        self.names = sorted({p.item for p in pieces if p.item is not None})
        number = {x: i for i, x in enumerate(self.names)}
        base = np.cumsum([0, *[len(p.words) for p in pieces]])
        join = lambda k, t: np.concatenate([np.frombuffer(p[k], t) for p in pieces]) if pieces else np.zeros(0, t)
        owner = np.concatenate([np.full(p.windows, number.get(p.item, -1)) for p in pieces]) if pieces else np.zeros(0, np.int64)
        shift = np.repeat(base[:-1], [p.windows for p in pieces]) if pieces else np.zeros(0, np.int64)
        self.words = b"".join(bytes(p.words) for p in pieces)
        hashes, length = join("hashes", np.uint64), join("lengths", np.int64)
        start, end = join("starts", np.int64) + shift, join("ends", np.int64) + shift
        order = np.lexsort((length, hashes))
        self.hashes, self.length, self.start, self.end, self.owner = (x[order] for x in (hashes, length, start, end, owner))
        # one entry per different window; its items follow one another in ``items``
        entry, first, items = [], [0], []
        runs = np.flatnonzero(np.diff(self.hashes, prepend=~self.hashes[:1])) if len(order) else np.zeros(0, np.int64)
        for low, high in zip(runs.tolist(), [*runs[1:].tolist(), len(order)]):
            texts: dict[tuple, list] = {}
            for i in range(low, high):
                texts.setdefault((int(self.length[i]), self.words[self.start[i] : self.end[i]]), []).append(i)
            for same in texts.values():
                entry.append(same[0])
                items += sorted({int(self.owner[i]) for i in same} - {-1})
                first.append(len(items))
        self.hashes, self.length, self.start, self.end = (x[entry] for x in (self.hashes, self.length, self.start, self.end))
        self.first, self.items = np.array(first), np.array(items, np.int64)
        self.lengths = sorted(set(self.length.tolist()))
        self.bits = np.uint64(max(8, int(len(self.hashes) * 16).bit_length()))
        self.bitmap = np.zeros(1 << int(self.bits), bool)
        self.bitmap[self.hashes >> (np.uint64(64) - self.bits)] = True
        del self.owner

    def scan(self, words: Words, first_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words lie under a confirmed window, and (text, item) pairs; windows stay inside a text."""
        count = len(words.start)
        depth = np.zeros(count + 1, np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        text_of = np.searchsorted(first_word, np.arange(count), side="right") - 1
        data = words.data.tobytes()
        for length in self.lengths:
            hashes = window_hashes(words.hash, length)
            some = np.flatnonzero(self.bitmap[hashes >> (np.uint64(64) - self.bits)])
            some = some[text_of[some] == text_of[some + length - 1]]
            low = np.searchsorted(self.hashes, hashes[some])
            high = np.searchsorted(self.hashes, hashes[some], side="right")
            known = low < high
            hit, entry = [], []
            for i, a, b in zip(some[known].tolist(), low[known].tolist(), high[known].tolist()):
                for e in range(a, b):
                    if self.length[e] == length and data[words.start[i] : words.end[i + length - 1]] == self.words[self.start[e] : self.end[e]]:
                        hit.append(i)
                        entry.append(e)
            if hit:
                hit, entry = np.array(hit), np.array(entry)
                np.add.at(depth, hit, 1)
                np.add.at(depth, hit + length, -1)
                # each different (text, window) names its items once
                text, entry = np.unique(np.stack([text_of[hit], entry]), axis=1)
                many = self.first[entry + 1] - self.first[entry]
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[entry], many)
                pairs.append(np.unique(np.stack([np.repeat(text, many), self.items[place]], axis=1), axis=0))
        return np.cumsum(depth[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)


def _found(texts: list[bytes], windows: WindowSet) -> list[tuple]:
    """RESULT of each text."""
    joined = b" ".join(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    begins = ends - [len(t) + 1 for t in texts]
    words = words_of(joined)
    first_word = np.searchsorted(words.text_start, begins)
    last_word = np.searchsorted(words.text_start, ends)
    marked, pairs = windows.scan(words, first_word)
    at = np.searchsorted(pairs[:, 0], np.arange(len(texts) + 1))
    out = []
    for t, (a, b) in enumerate(zip(first_word.tolist(), last_word.tolist())):
        edge = np.flatnonzero(np.diff(marked[a:b], prepend=False, append=False)) + a
        runs = []
        for f, l in zip(edge[0::2].tolist(), edge[1::2].tolist()):
            runs.append({"first": f - a, "words": l - f, "start": int(words.text_start[f] - begins[t]), "end": int(words.text_end[l - 1] - begins[t])})
        items = [windows.names[i] for i in pairs[at[t] : at[t + 1], 1].tolist()]
        out.append((b - a, runs, items, len(texts[t])))
    return out


def _sets(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> list[DataFrame]:
    """Pieces of the benchmark's windows, in sets of a counted size."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))
    pieces = freeze(rows.mapInArrow(_pieces(n), PIECE), "windows")
    parts = 1
    while True:
        part = F.pmod(F.xxhash64("item", "first", "hashes"), F.lit(parts))
        sizes = pieces.groupBy(part.alias("part")).agg(F.sum("windows").alias("windows"), F.sum("size").alias("bytes"))
        largest = sizes.agg(F.max(F.greatest(F.col("windows") / WINDOWS, F.col("bytes") / PIECE_BYTES)).alias("x")).first().x
        # one piece is far below both bounds, so more parts always end this
        if largest is None or largest <= 1 or parts > 1 << 20:
            return [pieces.filter(part == i) for i in range(parts)] if largest is not None else []
        parts *= 2


def _scanner(windows):
    """RESULT of a column of texts, some megabytes of them at a time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kind = to_arrow_type(StructType.fromDDL(RESULT))

    def scan(texts):
        done, held, size = [], [], 0
        for text in texts:
            held.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
            size += len(held[-1])
            if size >= SLICE_BYTES:
                done += _found(held, windows.value)
                held, size = [], 0
        if held:
            done += _found(held, windows.value)
        names = [f.name for f in kind]
        return pa.array([dict(zip(names, r)) for r in done], kind)

    scan.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return scan


def find(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, out: str = "leak"
) -> DataFrame:
    """``docs`` and a struct ``out``: n_words, ``hit`` runs of words (first, words, byte places start and end), ``items``."""
    spark = docs.sparkSession
    sets = _sets(benchmark, item_id, item_text, n) or [None]
    results = []
    for number, pieces in enumerate(sets):
        windows = spark.sparkContext.broadcast(WindowSet(pieces.collect() if pieces is not None else []))

        name = free_name(docs, f"{out}_{number}")
        docs = docs.withColumn(name, F.arrow_udf(_scanner(windows), RESULT)(F.col(f"`{text_col}`").cast("string")))
        results.append(name)
        if len(sets) > 1:
            docs = freeze(docs, "scanned")
            windows.destroy()
    if len(results) == 1:
        return docs.withColumnRenamed(results[0], out)
    return docs.withColumn(out, _together(results)).drop(*results)


def _together(results: list[str]) -> Column:
    """One result of several sets: runs of words that overlap or touch become one."""
    runs = F.array_sort(F.flatten(F.array(*[F.col(f"{r}.hit") for r in results])))

    def add(held: Column, run: Column) -> Column:
        last = F.element_at(held, -1)
        end = F.greatest(last["first"] + last["words"], run["first"] + run["words"])
        joined = F.struct(
            last["first"].alias("first"), (end - last["first"]).alias("words"), last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end")
        )
        meets = (F.size(held) > 0) & (F.try_element_at(held, F.lit(-1))["first"] + F.try_element_at(held, F.lit(-1))["words"] >= run["first"])
        return F.when(meets, F.concat(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(held, F.array(run)))

    empty = F.expr("cast(array() as array<struct<first:bigint,words:bigint,start:bigint,end:bigint>>)")
    items = F.array_distinct(F.flatten(F.array(*[F.col(f"{r}.items") for r in results])))
    return F.struct(
        F.col(f"{results[0]}.n_words").alias("n_words"), F.aggregate(runs, empty, add).alias("hit"), items.alias("items"), F.col(f"{results[0]}.size").alias("size")
    )


def without_spans(docs: DataFrame, text_col: str = "text", found: str = "leak") -> DataFrame:
    """Texts without the marked runs of words; documents without a hit stay as they are."""
    import pyarrow as pa

    def cut(texts, runs):
        out = []
        for text, hit in zip(texts, runs):
            text, hit = text.as_py(), hit.as_py()
            if text is not None and hit:
                raw, kept, at = text.encode("utf-8", "surrogatepass"), [], 0
                for r in hit:
                    kept.append(raw[at : r["start"]])
                    at = r["end"]
                text = b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")
            out.append(text)
        return pa.array(out, pa.string())

    cut.__annotations__ = {"texts": pa.Array, "runs": pa.Array, "return": pa.Array}
    return docs.withColumn(text_col, F.arrow_udf(cut, "string")(F.col(f"`{text_col}`").cast("string"), F.col(f"`{found}`.hit")))


def without_documents(docs: DataFrame, found: str = "leak") -> DataFrame:
    """Documents without any hit."""
    return docs.filter(F.size(F.col(f"`{found}`.hit")) == 0)


def leaks_in_documents(spark, sf: str) -> DataFrame:
    """The thin query: hits and items of every document."""
    docs = find(read(spark, sf, "documents").select("doc_id", "text"), read(spark, sf, "benchmark"))
    n_hit = F.aggregate("leak.hit", F.lit(0).cast("bigint"), lambda s, r: s + r["words"])
    return docs.select(
        "doc_id",
        F.col("leak.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("leak.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("leak.items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("leak.hit") > 0).alias("contaminated"),
    )
