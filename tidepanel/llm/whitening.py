"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The vectors are packed into blocks once. Every pass over the blocks forms Z'(ZQ) for the centred vectors Z and a thin matrix
Q (dimensions x ``BLOCK``), so the covariance itself is never formed; a task sends one matrix of Q's size, and these are
summed in ``SUMS`` tasks before they reach the driver. A round is a Chebyshev polynomial in the covariance V, by its
three-term recurrence, one pass a degree: it stays small on the unwanted spectrum, from 0 to the block's smallest Ritz value,
and grows fast above it. Then QR, one more pass VQ for Rayleigh-Ritz, and from the same pass the residuals |Vq - eq|. Rounds
end when the residuals of all wanted pairs are below ``TOLERANCE`` times the largest eigenvalue; if they never are, the fit
raises an error and gives no answer. A last pass measures how far the covariance of the whitened vectors is from the identity.

A component c becomes x = floor(1024 c) + 100000. Sums and deviations are whole numbers; centring takes the offset off
first, so nothing is lost to its size.

Defined results: rows whose vector is null or holds null, NaN or infinite entries take no part and are not returned; a
shorter vector counts as padded with zeros; equal rows each give their own result; directions whose eigenvalue is below
1e-12 of the largest are no components, so equal vectors, a single row or vectors without entries give no component;
an empty table gives an empty table; ``deviation`` is null where it does not fit into 64 bits. Other columns pass through
:meth:`Whitening.transform`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import free_name, read, slices
from tidepanel.scale import freeze

SCALE, OFFSET = 1024, 100000
COMPONENTS = 8
BLOCK = 32  # columns of Q
DEGREE = 10
ROUNDS = 60
TOLERANCE = 1e-13
RANK = 1e-12
BLOCK_BYTES = 1 << 20
SUMS = 16
SEED = 20
WHOLE = float(1 << 62)

PACKED = "size int, width int, largest double, data binary"


def _padded(values, scale: int) -> np.ndarray:
    """Rows of an Arrow list array as floor(scale * entry), as wide as the longest."""
    lengths = np.array([0 if n is None else n for n in values.value_lengths().to_pylist()], np.int64)
    flat = np.floor(scale * np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64))
    width = int(lengths.max(initial=0))
    if len(flat) == len(lengths) * width:
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _pack(scale: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 1024):
                y = _padded(part.column(0), scale)
                rows = max(1, BLOCK_BYTES // (8 * max(1, y.shape[1])))
                for at in range(0, len(y), rows):
                    z = y[at : at + rows]
                    largest = float(np.abs(z).max(initial=0.0))
                    row = ([len(z)], pa.int32()), ([z.shape[1]], pa.int32()), ([largest], pa.float64()), ([z.tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(*x) for x in row], ["size", "width", "largest", "data"])

    return run


def _summed(blocks: DataFrame, of_block, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all blocks of ``of_block(vectors)``, a matrix of this shape: per task, then in SUMS tasks, then here."""

    def per_task(batches):
        import pyarrow as pa

        total = np.zeros(shape)
        for batch in batches:
            for size, width, data in zip(*(batch.column(c).to_pylist() for c in ("size", "width", "data"))):
                total += of_block(np.frombuffer(data, np.float64).reshape(size, width))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def add(batches):
        import pyarrow as pa

        total, some = np.zeros(shape), False
        for batch in batches:
            for m in batch.column(0).to_pylist():
                total, some = total + np.frombuffer(m, np.float64).reshape(shape), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    sums = blocks.mapInArrow(per_task, "m binary").repartition(SUMS).mapInArrow(add, "m binary").collect()
    return sum((np.frombuffer(r.m, np.float64).reshape(shape) for r in sums), np.zeros(shape))


def _centred(y: np.ndarray, mean: np.ndarray) -> np.ndarray:
    z = np.tile(-mean, (len(y), 1))
    z[:, : y.shape[1]] += y
    return z


@dataclass
class Whitening:
    """Mean, components and eigenvalues of a fit list of ``n`` vectors; ``sums`` are of x without its offset."""

    n: int
    sums: list[int]
    components: np.ndarray  # dimensions x kept
    values: np.ndarray
    trace: float
    identity_error: float
    largest: float
    scale: int = SCALE
    residuals: list[float] = field(default_factory=list)
    passes: int = 0

    def transform(self, df: DataFrame, vector_col: str = "embedding", out: str = "whitening") -> DataFrame:
        """Usable rows of ``df`` with a struct ``out``: deviation long and whitened array of doubles."""
        n, sums, scale, largest = self.n, self.sums, self.scale, self.largest
        width, kept = self.components.shape
        mean = np.array([s / n for s in sums]) if n else np.zeros(width)
        project = self.components / np.sqrt(self.values)[None, :]
        # whole numbers of 64 bits are enough for n * x - S, its square and their sum
        narrow = width * (2.0 * max(n, 1) * max(largest, 1.0)) ** 2 < WHOLE

        def whitened(vectors):
            import pyarrow as pa

            deviations, points, count = [], [], []
            for part in slices(vectors, 1024):
                y = _padded(part, scale)
                points.append((_centred(y, mean) @ project).ravel())
                count.append(len(y))
                wide = np.zeros((len(y), width))
                wide[:, : y.shape[1]] = y
                if narrow:
                    gap = n * wide.astype(np.int64) - np.array(sums, np.int64)[None, :]
                    deviations += (gap * gap).sum(1).tolist()
                else:
                    exact = [sum((n * int(x) - s) ** 2 for x, s in zip(row, sums)) for row in wide]
                    deviations += [e if e < 1 << 63 else None for e in exact]
            ends = pa.array(np.arange(sum(count) + 1) * kept, pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(points), pa.float64()))
            return pa.StructArray.from_arrays([pa.array(deviations, pa.int64()), lists], ["deviation", "whitened"])

        import pyarrow as pa

        whitened.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
        make = F.arrow_udf(whitened, "deviation bigint, whitened array<double>")
        return usable(df, vector_col).withColumn(out, make(F.col(f"`{vector_col}`").cast("array<double>")))


def usable(df: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there and has finite entries only."""
    vector = F.col(f"`{vector_col}`")
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return df.filter(vector.isNotNull() & F.coalesce(finite, F.lit(False)))


def fit(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Whitening:
    """Leading eigenpairs of the covariance of floor(scale * vector) over all usable rows."""
    vectors = usable(df, vector_col).select(F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    blocks = freeze(vectors.mapInArrow(_pack(scale), PACKED), "vectors")
    head = blocks.agg(F.sum("size").alias("n"), F.max("width").alias("d"), F.max("largest").alias("largest")).first()
    n, d, largest = int(head.n or 0), int(head.d or 0), float(head.largest or 0)
    if not n or not d:
        return Whitening(n, [0] * d, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, largest, scale)

    def sums_of(y):
        # two halves of 30 bits, each summed exactly in doubles
        out = np.zeros((3, d))
        high = np.floor(y / (1 << 30))
        out[0, : y.shape[1]], out[1, : y.shape[1]] = high.sum(0), (y - high * (1 << 30)).sum(0)
        return out

    halves = _summed(blocks, sums_of, (3, d))
    sums = [int(h) * (1 << 30) + int(low) for h, low in zip(halves[0], halves[1])]
    mean = np.array([s / n for s in sums])

    def spread_of(y):
        z = _centred(y, mean)
        return np.array([[(z * z).sum() / n, 0.0]])

    trace = float(_summed(blocks, spread_of, (1, 2))[0, 0])
    passes = 2

    def apply(q: np.ndarray) -> np.ndarray:
        """VQ by one pass."""
        nonlocal passes
        passes += 1

        def of_block(y):
            z = _centred(y, mean)
            return z.T @ (z @ q) / n

        return _summed(blocks, of_block, q.shape)

    b = min(d, max(BLOCK, 4 * components))
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, b)))[0]
    q, values, residuals = _ritz(q, apply(q))
    best, rounds = np.inf, 0
    while True:
        kept = int((values[:components] > RANK * values[0]).sum()) if values[0] > 0 else 0
        worst = float(residuals[:kept].max(initial=0.0)) / max(values[0], 1e-300)
        # below the tolerance, or at the end of what doubles can say
        if worst <= TOLERANCE or (worst <= 100 * TOLERANCE and worst > 0.5 * best):
            break
        if rounds == ROUNDS:
            raise RuntimeError(f"whitening not certified: residual {worst:.1e} of the largest eigenvalue after {passes} passes")
        best, rounds = min(best, worst), rounds + 1
        q, values, residuals = _ritz(*_filtered(q, apply, float(max(values[-1], RANK * values[0])), float(values[0])))
    project = q[:, :kept] / np.sqrt(values[:kept])[None, :]

    def covariance_of(y):
        p = _centred(y, mean) @ project
        return p.T @ p / n

    error = float(np.abs(_summed(blocks, covariance_of, (kept, kept)) - np.eye(kept)).max()) if kept else 0.0
    return Whitening(n, sums, q[:, :kept], values[:kept], trace, error, largest, scale, residuals[:kept].tolist(), passes)


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz in the span of ``q``: vectors, falling values and residual lengths."""
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    q, vq = q @ turn, vq @ turn
    return q, values, np.sqrt(((vq - q * values[None, :]) ** 2).sum(0))


def _filtered(q: np.ndarray, apply, cut: float, top: float) -> tuple[np.ndarray, np.ndarray]:
    """An orthonormal basis of T(V)q, T of degree DEGREE small on 0 to ``cut`` and 1 at ``top``, and V times it."""
    middle, half = cut / 2, cut / 2
    scaled = half / (top - middle)
    sigma = scaled
    before, now = q, (apply(q) - middle * q) * (sigma / half)
    for _ in range(DEGREE - 1):
        after = 1 / (2 / scaled - sigma)
        before, now, sigma = now, (apply(now) - middle * now) * (2 * after / half) - before * (sigma * after), after
    q = np.linalg.qr(now)[0]
    return q, apply(q)


def whiten_embeddings(spark, sf: str) -> DataFrame:
    """One row per usable vector and component: the thin query over ``embeddings``."""
    vectors = read(spark, sf, "embeddings")
    model = fit(vectors)
    out = free_name(vectors, "whitening")
    rows = model.transform(vectors.select("vec_id", "embedding"), out=out)
    rows = rows.select("vec_id", F.col(f"{out}.deviation").alias("deviation"), F.posexplode(f"{out}.whitened").alias("at", "whitened"))
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    return rows.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained") if len(model.values) else F.lit(None).cast("double").alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
