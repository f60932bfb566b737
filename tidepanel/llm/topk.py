"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length across the cluster and packed into buckets of neighbouring lengths, queries into blocks. Each
query first meets the bucket of the longest vectors, which gives it a lower bound for its k-th score. From these bounds follows, per
query block, how long a bucket's longest vector must be; a bucket is sent to the blocks that it can still serve, and to no other.
Where lengths are alike, that is every block, and the work grows with buckets times blocks. Inside a pair, each query's bound
becomes a local cosine threshold for that bucket: above 1 the bucket is skipped; if it is high, a coordinate decides
(only vectors whose angle to the query's largest coordinate is near enough can qualify, found in a sorted list); else
the vectors long enough are taken. What is left is verified by exact products, and bounds rise as a task goes on.

Products are formed in doubles where all sums are below 2**53, else in whole numbers of any size.

Defined results: vectors that are null or hold a null or non-finite component, and rows without an id, take no part; a
shorter vector counts as padded with zeros; equal scores go to the smaller id, and equal ids keep separate rows; a query
never finds its own row; with fewer than k candidates all are returned; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import read
from tidepanel.scale import freeze

BLOCK_BYTES = 1 << 20
QUERY_ROWS = 1024
GROUPS = 24
COORDINATE_FROM = 0.85
SLACK = 1e-9
EXACT = float(1 << 53)

PACKED = "block bigint, size int, width int, longest double, ids binary, rows binary, data binary"


def _pack(most_rows: int | None):
    """Rows (vec_id, row, v), in the order they come, into blocks."""

    def run(batches):
        import pyarrow as pa

        first, number = TaskContext.get().partitionId() << 32, 0

        def block(held):
            nonlocal number
            width = max(len(v) for _, _, v in held)
            data = np.zeros((len(held), width), np.float64)
            for i, (_, _, v) in enumerate(held):
                data[i, : len(v)] = v
            ids, rows = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
            number += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([first + number], pa.int64()),
                    pa.array([len(held)], pa.int32()),
                    pa.array([width], pa.int32()),
                    pa.array([float(np.sqrt((data * data).sum(1).max()))], pa.float64()),
                    pa.array([ids.tobytes()], pa.binary()),
                    pa.array([rows.tobytes()], pa.binary()),
                    pa.array([data.tobytes()], pa.binary()),
                ],
                [c.split()[0] for c in PACKED.split(", ")],
            )

        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += 8 * max(1, len(row[2]))
                if size >= BLOCK_BYTES or (most_rows and len(held) >= most_rows):
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    return run


class Block:
    """A packed block: ids, row numbers, vectors and their lengths."""

    def __init__(self, size, width, ids, rows, data):
        self.ids, self.rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
        self.data = np.frombuffer(data, np.float64).reshape(size, width)
        self.norm = np.sqrt((self.data * self.data).sum(1))
        self._sorted: dict[int, tuple] = {}

    def by_angle(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines to one axis, sorted, and the rows they belong to."""
        if coordinate not in self._sorted:
            cosine = self.data[:, coordinate] / np.maximum(self.norm, 1e-300)
            order = np.argsort(cosine, kind="stable")
            self._sorted[coordinate] = cosine[order], order
        return self._sorted[coordinate]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not width:
        return np.zeros((len(a), len(b)))
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width < EXACT:
        return a @ b.T
    whole = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    return whole


class Best:
    """The k best candidates of each query of a block, found so far."""

    def __init__(self, queries: Block, k: int, bound: np.ndarray):
        self.queries, self.k = queries, k
        self.bound = bound.astype(float).copy()  # scores below it cannot be among the k best
        self.q = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.row = np.zeros(0, np.int64)
        self.score = np.zeros(0, object)

    def meet(self, block: Block) -> None:
        norm = self.queries.norm
        longest = float(block.norm.max(initial=0))
        reach = norm * longest * (1 + SLACK)
        local = np.where(reach > 0, self.bound / np.maximum(reach, 1e-300), np.where(self.bound > 0, 2.0, -1.0))
        near = np.flatnonzero((local <= 1) & (local >= COORDINATE_FROM))
        wide = np.flatnonzero(local < COORDINATE_FROM)
        if len(wide):
            low = float((self.bound[wide] / np.maximum(norm[wide], 1e-300)).min())
            some = np.flatnonzero(block.norm * (1 + SLACK) >= low)
            if len(some):
                score = _products(self.queries.data[wide], block.data[some])
                own = self.queries.rows[wide][:, None] == block.rows[some][None, :]
                bound = self.bound[wide].copy()
                if len(some) > self.k and score.dtype != object:
                    free = np.where(own, -np.inf, score)
                    bound = np.maximum(bound, np.partition(free, -self.k, axis=1)[:, -self.k])
                i, j = np.nonzero((score >= bound[:, None]) & ~own)
                self._add(wide[i], block, some[j], score[i, j])
        for i in near.tolist():
            q = self.queries.data[i]
            axis = int(np.abs(q).argmax())
            cosine, order = block.by_angle(axis) if axis < block.data.shape[1] else (np.zeros(len(block.ids)), np.arange(len(block.ids)))
            angle = float(np.arccos(np.clip(q[axis] / norm[i], -1, 1)))
            room = float(np.arccos(np.clip(local[i] - SLACK, -1, 1))) + SLACK
            a = np.searchsorted(cosine, np.cos(min(np.pi, angle + room)) - SLACK)
            b = np.searchsorted(cosine, np.cos(max(0.0, angle - room)) + SLACK, side="right")
            some = order[a:b]
            some = some[block.rows[some] != self.queries.rows[i]]
            if len(some):
                score = _products(q[None, :], block.data[some])[0]
                keep = np.flatnonzero(score >= self.bound[i])
                self._add(np.full(len(keep), i), block, some[keep], score[keep])
        self._cut()

    def _add(self, q, block: Block, at, score) -> None:
        self.q = np.concatenate([self.q, q])
        self.id = np.concatenate([self.id, block.ids[at]])
        self.row = np.concatenate([self.row, block.rows[at]])
        self.score = np.concatenate([self.score, np.asarray(score, object) if score.dtype == object else score.astype(np.int64).astype(object)])

    def _cut(self) -> None:
        if not len(self.q):
            return
        big = max(abs(int(self.score.max())), abs(int(self.score.min()))) >= 1 << 62
        value = self.score if big else self.score.astype(np.int64)
        order = sorted(range(len(value)), key=lambda i: (self.q[i], -value[i], self.id[i], self.row[i])) if big else np.lexsort((self.row, self.id, -value, self.q))
        self.q, self.id, self.row, self.score = (x[order] for x in (self.q, self.id, self.row, self.score))
        first = np.searchsorted(self.q, self.q)
        rank = np.arange(len(self.q)) - first
        full = rank == self.k - 1
        self.bound[self.q[full]] = np.maximum(self.bound[self.q[full]], self.score[full].astype(float))
        keep = rank < self.k
        self.q, self.id, self.row, self.score = (x[keep] for x in (self.q, self.id, self.row, self.score))


def _seed(k: int, longest):
    """Query blocks with a lower bound for the k-th score of each query."""

    def run(batches):
        import pyarrow as pa

        top = [Block(*r) for r in longest.value]
        for batch in batches:
            bounds, least = [], []
            for size, width, ids, rows, data in zip(*(batch.column(c).to_pylist() for c in ("size", "width", "ids", "rows", "data"))):
                queries = Block(size, width, ids, rows, data)
                best = Best(queries, k, np.full(size, -np.inf))
                for block in top:
                    best.meet(block)
                bounds.append(best.bound.tobytes())
                # the shortest longest vector that a bucket must have for any of these queries
                ratio = best.bound / np.maximum(queries.norm * (1 + SLACK), 1e-300)
                least.append(float(np.where(queries.norm > 0, ratio, np.where(best.bound > 0, np.inf, -np.inf)).min()))
            columns = [*batch.columns, pa.array(bounds, pa.binary()), pa.array(least, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "bounds", "least"])

    return run


def _search(k: int):
    """Best candidates of each query block over the buckets it meets in this task."""

    def run(batches):
        import pyarrow as pa

        best, number = None, None

        def out():
            q = best.queries.ids[best.q]
            arrays = [pa.array(x, pa.int64()) for x in (q, best.queries.rows[best.q], best.id, best.row, [int(s) for s in best.score])]
            return pa.RecordBatch.from_arrays(arrays, ["query_id", "query_row", "vec_id", "vec_row", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["q_block"] != number:
                    if best is not None:
                        yield out()
                    queries = Block(r["q_size"], r["q_width"], r["q_ids"], r["q_rows"], r["q_data"])
                    best, number = Best(queries, k, np.frombuffer(r["q_bounds"], np.float64)), r["q_block"]
                best.meet(Block(r["size"], r["width"], r["ids"], r["rows"], r["data"]))
        if best is not None:
            yield out()

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` best inner products of floor(scale * x) for rows where ``is_query``."""
    spark = vectors.sparkSession
    usable = F.forall(F.col(vector_col), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double") * scale)
    # floor of a double beyond 64 bits is the double itself
    whole = F.transform(wide, lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(F.when(F.abs(x) < float(1 << 53), x).otherwise(0.0)).cast("double")).otherwise(x))
    base = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(usable, F.lit(False)))
    base = base.select(F.col(id_col).cast("bigint").alias("vec_id"), whole.alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    base = base.select("vec_id", "v", norm.alias("norm"), F.monotonically_increasing_id().alias("row"))
    base = freeze(base, "vectors")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the row number keeps equal lengths apart
    ranged = base.repartitionByRange(parts, F.col("norm").desc(), "row").sortWithinPartitions(F.col("norm").desc(), "row")
    buckets = freeze(ranged.select("vec_id", "row", "v").mapInArrow(_pack(None), PACKED), "buckets")

    queries = base.filter(is_query).select("vec_id", "row", "v", "norm")
    n = max(1, -(-queries.count() // QUERY_ROWS))
    queries = queries.repartition(n, F.xxhash64("row")).sortWithinPartitions(F.col("norm").desc(), "row")
    queries = queries.select("vec_id", "row", "v").mapInArrow(_pack(QUERY_ROWS), PACKED)
    top = buckets.orderBy(F.col("longest").desc(), "block").limit(1).select("size", "width", "ids", "rows", "data").collect()
    longest = spark.sparkContext.broadcast([tuple(r) for r in top])  # one bucket of BLOCK_BYTES
    queries = freeze(queries.mapInArrow(_seed(k, longest), f"{PACKED}, bounds binary, least double"), "queries")
    q = queries.drop("least").select(*[F.col(c).alias(f"q_{c}") for c in queries.columns if c != "least"])

    # a bucket goes to the query blocks that its longest vector can still serve; a number and a bound per QUERY_ROWS queries
    asking = queries.agg(F.collect_list(F.struct("block", "least")).alias("x")).select("x").scalar()
    served = F.filter(F.col("asking"), lambda x: F.col("longest") >= x["least"])
    group = F.pmod(F.xxhash64("block"), F.lit(GROUPS))
    dealt = buckets.withColumns({"g": group, "asking": asking}).withColumn("q_block", F.explode(F.transform(served, lambda x: x["block"])))
    dealt = dealt.drop("asking")
    asked = q.withColumn("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(GROUPS - 1).cast("bigint"))))
    both = dealt.join(asked.hint("shuffle_hash"), ["q_block", "g"])
    both = both.sortWithinPartitions("q_block", F.col("longest").desc())
    schema = "query_id bigint, query_row bigint, vec_id bigint, vec_row bigint, score bigint"
    found = both.select(*[c for c in buckets.columns], *q.columns).mapInArrow(_search(k), schema)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "vec_row")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def nearest_embeddings(spark, sf: str) -> DataFrame:
    return top_k(read(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)
