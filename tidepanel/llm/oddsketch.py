"""Near-duplicate groups: banded MinHash, odd sketches, exact confirmation on whole shingle sets.

A document's set holds the hashes (64 bits) of its distinct runs of five words. Documents with equal sets form a class;
all further work is on classes. Each class has ``ROWS * BANDS`` MinHash samples. They are used twice: bands of five
samples are bucket keys, and all samples are folded into one parity bitmap, the odd sketch. Two sets of similarity J differ
in about ``(1 - J) * samples`` samples and so in at most twice as many bits of the bitmaps; a pair whose bitmaps differ in
more bits than a similar pair practically ever does is dropped unread, the rest is confirmed on the full sets.

Candidates are asked for in two steps, so that a large group of near copies is never expanded into all its pairs:

1. each member of a bucket with the smallest member of the bucket (each class is tried with its few most alike first);
   confirmed links join classes to components;
2. only for buckets that still hold several components: members of different components. The largest component of a
   bucket is never compared with itself. Both sides are split into blocks of bounded size, so a task holds two blocks at
   a time, whatever the size of the bucket. Pairs are never written out: the bitmaps tell which rows of two blocks
   have something to compare, those rows fetch their sets, and a pair is read only while its components are apart.

A pair of similarity 0.85 is missed by all bands with a probability of 1e-8, one of 0.8 with 3e-6; by the bitmap bound, which
follows the threshold, with 1e-7.

Defined results: null texts and texts without a word have an empty set, no links, and are kept; a text of fewer words than
a shingle is one shingle; repeated rows fall in one class; a component's id is its smallest document id (missing ids
are passed over); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.bpe import in_chunks
from tidepanel.llm.common import free_name, slices
from tidepanel.scale import freeze

WORDS, ROWS, BANDS, SKETCH_BITS = 5, 5, 32, 1024
SAMPLES = ROWS * BANDS
THRESHOLD = (85, 100)
BLOCK = 256
FIRST_TRIED = 3
PIECE = 1 << 20

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _numbers(seed: int, n: int) -> np.ndarray:
    return _mix((np.arange(1, n + 1, dtype=U) + U(seed << 32)) * U(0x9E3779B97F4A7C15))


_BYTE = _numbers(1, 256)
_PLACE = _numbers(2, 64) | U(1)
_STEP = int(_numbers(3, 1)[0] | U(1))
_MASK, _ODD = _numbers(4, SAMPLES), _numbers(5, SAMPLES) | U(1)
_SAMPLE = _numbers(6, SAMPLES)
_powers = (np.ones(1, U), np.ones(1, U))


def _place_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        back = pow(_STEP, -1, 1 << 64)
        made = []
        for base in (_STEP, back):
            steps = np.full(n, base, U)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers = tuple(made)
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of a lower-cased text; long texts are cut between words."""
    hashes, begins, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        raw = np.frombuffer(data[at:end], np.uint8)
        space = _SPACE[raw]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        first, last = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
        if len(first):
            power, back = _place_powers(max(PIECE, len(raw)) + 1)
            total = np.zeros(len(raw) + 1, U)
            np.cumsum(_BYTE[raw] * power[: len(raw)], out=total[1:])
            hashes.append(_mix((total[last] - total[first]) * back[first]))
            begins.append(first + at)
        at = end
    if not hashes:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(begins)


def shingle_sets(texts: list) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    encoded = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    hashes, begins = word_hashes(b"\n".join(encoded))
    edges = np.cumsum([0] + [len(e) + 1 for e in encoded])
    at = np.searchsorted(begins, edges).tolist()
    n = max(0, len(hashes) - WORDS + 1)
    runs = np.zeros(n, U)
    for j in range(WORDS):
        runs += hashes[j : j + n] * _PLACE[j]
    runs = _mix(runs)
    out = []
    for a, b in zip(at, at[1:]):
        if b - a >= WORDS:
            out.append(np.unique(runs[a : b - WORDS + 1]))
        elif b > a:
            out.append(_mix((hashes[a:b] * _PLACE[: b - a]).sum(dtype=U, keepdims=True) + _PLACE[WORDS + b - a]))
        else:
            out.append(np.zeros(0, U))
    return out


def samples_of(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, a row per (non-empty) set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), SAMPLES), U)
    for j in range(SAMPLES):
        out[:, j] = np.minimum.reduceat((flat ^ _MASK[j]) * _ODD[j], starts)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, 64-bit words in a row per set."""
    bit = (_mix(samples ^ _SAMPLE) % U(SKETCH_BITS)).astype(np.int64)
    rows = len(samples)
    place = bit + SKETCH_BITS * np.arange(rows)[:, None]
    odd = (np.bincount(place.ravel(), minlength=rows * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(rows, -1), axis=1).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    groups = samples.reshape(len(samples), BANDS, ROWS)
    return _mix((groups * _PLACE[:ROWS]).sum(2, dtype=U) + _numbers(7, BANDS)).view(np.int64)


def most_different_bits(threshold=THRESHOLD, samples: int = SAMPLES) -> int:
    """Bits in which two bitmaps may differ: of similar pairs one in 1e7 has more different samples."""
    p, tail, n = 1 - threshold[0] / threshold[1], 0.0, samples
    chance = p**n  # all samples differ; go down until the tail is too likely
    while n > 0 and tail + chance < 1e-7:
        tail += chance
        chance *= n / (samples - n + 1) * (1 - p) / p
        n -= 1
    return 2 * n


def _describe(batches):
    import pyarrow as pa

    for batch in (part for whole in batches for part in slices(whole)):
        ids, keys, texts = (c.to_pylist() for c in batch.columns)
        at = 0
        for run in in_chunks([t or "" for t in texts], 1_000_000):
            met, place = {}, []
            for t in run:
                place.append(met.setdefault(t, len(met)))
            sets = shingle_sets(list(met))
            full = [i for i, s in enumerate(sets) if len(s)]
            bands, sketch = [None] * len(sets), [None] * len(sets)
            if full:
                samples = samples_of([sets[i] for i in full])
                for i, k, o in zip(full, band_keys(samples).tolist(), odd_sketches(samples).tolist()):
                    bands[i], sketch[i] = k, o
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            end = at + len(run)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[at:end], batch.schema.field(0).type),
                    pa.array(keys[at:end], pa.string()),
                    pa.array([len(sets[i]) for i in place], pa.int64()),
                    pa.array([digest[i] for i in place], pa.binary()),
                    pa.array([bands[i] for i in place], pa.list_(pa.int64())),
                    pa.array([sketch[i] for i in place], pa.list_(pa.int64())),
                ],
                ["doc_id", "tid", "n_shingles", "sig", "bands", "sketch"],
            )
            at = end


def _sets(batches):
    import pyarrow as pa

    for batch in (part for whole in batches for part in slices(whole)):
        sigs, texts = (c.to_pylist() for c in batch.columns)
        at = 0
        for run in in_chunks([t or "" for t in texts], 1_000_000):
            end = at + len(run)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sigs[at:end], pa.binary()), pa.array([s.tobytes() for s in shingle_sets(run)], pa.binary())],
                ["sig", "hashes"],
            )
            at = end


def _similar(a: np.ndarray, b: np.ndarray, threshold) -> bool:
    """Whether two sets (sorted, distinct) are similar enough."""
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return threshold[1] * common >= threshold[0] * (len(a) + len(b) - common)


def _confirm(threshold):
    def run(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in slices(whole)):
            left, right = batch.column(0), batch.column(1)
            keep, before, a = [], None, None
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                key = left[i].as_py()
                if key != before:
                    before, a = key, np.frombuffer(x.as_py(), U)
                keep.append(_similar(a, np.frombuffer(y.as_py(), U), threshold))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([left.filter(keep), right.filter(keep)], ["a", "b"])

    return run


def confirm(pairs: DataFrame, sets: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough.

    The second member's set is fetched first; so a class that many pairs have as their first member is not carried along.
    """
    right = sets.select(F.col("sig").alias("b"), F.col("hashes").alias("hashes_b"))
    left = sets.select(F.col("sig").alias("a"), F.col("hashes").alias("hashes_a"))
    both = pairs.join(right, "b").join(left, "a")
    return both.select("a", "b", "hashes_a", "hashes_b").mapInArrow(_confirm(threshold), "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(sig, root) of every class with a link: its component's smallest class.

    Alternating star contraction: neighbours are joined to the smallest one nearby until nothing changes. Each step is a
    grouped minimum and a join; its links are written, so lineage stays short.
    """
    edges = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m"))
    edges = freeze(edges.filter("v != m").distinct(), "links")
    count = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
    while True:
        around = edges.unionByName(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = around.groupBy("v").agg(F.least(F.min("m"), F.first("v")).alias("low"))
        large = around.join(low, "v").filter("m > v").select(F.col("m").alias("v"), F.col("low").alias("m"))
        low = large.filter("v != m").groupBy("v").agg(F.min("m").alias("low"))
        small = large.filter("v != m").join(low, "v")
        small = small.select("m", "low").filter("m != low").select(F.col("m").alias("v"), F.col("low").alias("m"))
        small = small.unionByName(low.select("v", F.col("low").alias("m")))
        edges = freeze(small.distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == count:
            break
        count = now
    roots = edges.select(F.col("v").alias("sig"), F.col("m").alias("root"))
    return roots.unionByName(edges.select(F.col("m").alias("sig"), F.col("m").alias("root")).distinct())


def _different(left: str, right: str):
    """Bits in which two bitmap columns differ."""
    return F.aggregate(
        F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n
    )


CELL = "key bigint, cell string, side int, sig binary, root binary, sketch array<bigint>, bands array<bigint>"


def _cells(batches):
    """Runs of rows of one cell, which come one after another; a cell is two blocks at most."""
    held, cell = [], None
    for batch in (part for whole in batches for part in slices(whole)):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != cell:
                if held:
                    yield held
                held, cell = [], row[:2]
            held.append(row)
    if held:
        yield held


def _wanted(rows: list, limit: int) -> list[tuple[int, int]]:
    """Pairs of rows of a cell that must be compared, the most alike first.

    They lie in different components, their bitmaps are near enough, and no earlier band puts them in one bucket (then
    they are compared there).
    """
    first = [i for i, r in enumerate(rows) if r[2] == 0]
    second = [i for i, r in enumerate(rows) if r[2] == 1]
    same = not second
    second = first if same else second
    if not first or len(rows) < 2:
        return []
    names: dict = {}
    group = np.array([names.setdefault(r[4], len(names)) for r in rows])
    bits = np.array([r[5] for r in rows], np.int64).view(U)
    bands = np.array([r[6] for r in rows], np.int64)
    differ = np.bitwise_count(bits[first][:, None, :] ^ bits[second][None, :, :]).sum(2)
    x, y = np.nonzero((differ <= limit) & (group[first][:, None] != group[second][None, :]))
    near = differ[x, y]
    x, y = np.array(first)[x], np.array(second)[y]
    keep = x < y if same else np.ones(len(x), bool)
    x, y, near = x[keep], y[keep], near[keep]
    if len(x):
        shared = bands[x] == bands[y]
        here = bands[x] == rows[0][0]
        keep = shared.argmax(1) == here.argmax(1)
        x, y, near = x[keep], y[keep], near[keep]
    order = np.argsort(near, kind="stable")
    return list(zip(x[order].tolist(), y[order].tolist()))


def _involved(limit):
    """The rows of each cell that have a pair to compare."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = [c.split()[0] for c in CELL.split(", ")]
        out: list = []

        def batch():
            columns = zip(*out) if out else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for rows in _cells(batches):
            out += [rows[i] for i in sorted({i for pair in _wanted(rows, limit) for i in pair})]
            if len(out) >= 2000:
                yield batch()
                out = []
        yield batch()

    return run


def _links(limit, threshold):
    """Links between the components met in each cell, confirmed on the sets; one for each two that get joined."""

    def run(batches):
        import pyarrow as pa

        for rows in _cells(batches):
            parent: dict = {}

            def root(x):
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            found, sets = [], {}
            for i, j in _wanted(rows, limit):
                x, y = root(rows[i][4]), root(rows[j][4])
                if x == y:
                    continue
                for k in (i, j):
                    if k not in sets:
                        sets[k] = np.frombuffer(rows[k][7], U)
                if _similar(sets[i], sets[j], threshold):
                    parent[x] = y
                    found.append((rows[i][3], rows[j][3]))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def across_components(
    members: DataFrame, sketches: DataFrame, roots: DataFrame, sets: DataFrame, limit: int, threshold=THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """Confirmed links (a, b) of classes that share a bucket but no component.

    A cell is a bucket's block of the largest component beside a block of the others, or two blocks of the others. Cells
    are read twice: first with the bitmaps only, then what is left of them with the sets.
    """
    member = members.select("key", "sig").join(roots, "sig", "left")
    member = member.withColumn("root", F.coalesce("root", "sig"))
    sizes = member.groupBy("key", "root").agg(F.count("*").alias("n"))
    bucket = sizes.groupBy("key").agg(
        F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("parts")
    )
    bucket = bucket.filter("parts > 1").select(
        "key",
        F.col("top.root").alias("main"),
        F.ceil(F.col("top.n") / block).cast("int").alias("main_blocks"),
        F.ceil((F.col("all") - F.col("top.n")) / block).cast("int").alias("blocks"),
    )
    member = member.join(bucket, "key").withColumn("is_main", F.col("root") == F.col("main"))
    spread = F.xxhash64("sig", "key")
    own = F.when(F.col("is_main"), F.pmod(spread, F.col("main_blocks"))).otherwise(F.pmod(spread, F.col("blocks")))
    member = member.withColumn("own", own.cast("int"))
    # side 0 and side 1 of a cell; cells of one block with itself have side 0 alone
    main_cells = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.lit(-1).alias("x"), F.col("own").alias("y"), j.alias("z"), F.lit(0).alias("side")),
    )
    with_main = F.transform(
        F.sequence(F.lit(0), F.col("main_blocks") - 1),
        lambda i: F.struct(F.lit(-1).alias("x"), i.alias("y"), F.col("own").alias("z"), F.lit(1).alias("side")),
    )
    with_others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(
            F.lit(0).alias("x"),
            F.least("own", j).alias("y"),
            F.greatest("own", j).alias("z"),
            (F.col("own") > j).cast("int").alias("side"),
        ),
    )
    cells = F.when(F.col("is_main"), main_cells).otherwise(F.concat(with_main, with_others))
    rows = member.join(sketches, "sig").select("key", "sig", "root", "sketch", "bands", F.explode(cells).alias("c"))
    names = [c.split()[0] for c in CELL.split(", ")]
    rows = rows.withColumns({"cell": F.concat_ws(",", "c.x", "c.y", "c.z"), "side": F.col("c.side")}).select(*names)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key", "cell").sortWithinPartitions("key", "cell")
    left = freeze(rows.mapInArrow(_involved(limit), CELL), "cells")
    whole = left.join(sets, "sig").select(*names, "hashes")
    whole = whole.repartition(parts, "key", "cell").sortWithinPartitions("key", "cell")
    return whole.mapInArrow(_links(limit, threshold), "a binary, b binary")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold=THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row, with ``tid``, a digest of its text, and its ``group_id``.

    ``group_id`` tells groups apart where ids are missing or used twice; it is null for texts without a word.
    """
    base = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("tid", F.md5(F.col("text").cast("binary")))
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, tid string, n_shingles bigint, sig binary, bands array<bigint>, sketch array<bigint>"
    rows = freeze(base.select("doc_id", "tid", "text").mapInArrow(_describe, schema), "rows")
    classes = rows.filter("n_shingles > 0").groupBy("sig").agg(
        F.min("doc_id").alias("low"), F.min("tid").alias("tid"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"),
    )
    classes = freeze(classes, "classes")

    in_bucket = classes.select("sig", F.explode("bands").alias("key"))
    buckets = in_bucket.groupBy("key").agg(F.count("*").alias("n"), F.min("sig").alias("rep")).filter("n > 1")
    members = freeze(in_bucket.join(buckets.select("key", "rep"), "key"), "members")
    active = members.select("sig").distinct()
    sketches = freeze(classes.join(active, "sig", "left_semi").select("sig", "tid", "sketch", "bands"), "sketches")
    texts = base.select("tid", "text").join(sketches.select("sig", "tid"), "tid")
    texts = texts.select("sig", "text")
    sets = freeze(texts.dropDuplicates(["sig"]).mapInArrow(_sets, "sig binary, hashes binary"), "sets")

    limit, bitmap = most_different_bits(threshold), sketches.select("sig", "sketch")
    pairs = members.filter("sig != rep").select(F.col("rep").alias("a"), F.col("sig").alias("b")).distinct()
    pairs = pairs.join(bitmap.toDF("b", "sketch_b"), "b").join(bitmap.toDF("a", "sketch_a"), "a")
    pairs = pairs.withColumn("differ", _different("sketch_a", "sketch_b")).filter(F.col("differ") <= limit)
    nearest = F.row_number().over(Window.partitionBy("b").orderBy("differ", "a"))
    pairs = pairs.withColumn("r", nearest).filter(F.col("r") <= FIRST_TRIED).select("a", "b")
    links = freeze(confirm(pairs, sets, threshold), "confirmed")
    roots = freeze(components(links), "roots")
    late = freeze(across_components(members, sketches.drop("tid"), roots, sets, limit, threshold), "confirmed")
    if not late.isEmpty():
        roots = components(links.unionByName(late))

    labelled = classes.select("sig", "low").join(roots, "sig", "left")
    labelled = labelled.withColumn("root", F.coalesce("root", "sig"))
    lowest = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    labelled = labelled.join(lowest, "root").select("sig", "component_id", F.col("root").alias("group_id"))
    out = rows.select("doc_id", "tid", "n_shingles", "sig").join(labelled, "sig", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", component)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "tid", "group_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold=THRESHOLD) -> DataFrame:
    """One row of each group stays: that of the smallest id, then of the smallest text digest; all columns as they are.

    Rows equal in id and text are one. Texts without a word are in no group and all stay.
    """
    found = near_duplicates(df, id_col, text_col, threshold).filter(F.col("n_shingles") > 0)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "tid")).alias("first")
    key, digest, place = free_name(df, "_id"), free_name(df, "_digest"), free_name(df, "_place")
    kept = found.groupBy("group_id").agg(first)
    kept = kept.select(F.col("first.doc_id").alias(key), F.col("first.tid").alias(digest + "_k"))
    rows = df.withColumn(digest, F.md5(F.col(f"`{text_col}`").cast("string").cast("binary")))
    same = rows[id_col].eqNullSafe(kept[key]) & (rows[digest] == kept[digest + "_k"])
    has_word = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    stay = rows.filter(has_word).join(kept, same, "left_semi")
    number = F.row_number().over(Window.partitionBy(id_col, digest).orderBy(digest))
    stay = stay.withColumn(place, number).filter(F.col(place) == 1).drop(place, digest)
    return stay.unionByName(df.filter(~has_word))
