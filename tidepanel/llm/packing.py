"""Hierarchical packing of documents into sequences of several context sizes.

Each task packs the documents of its own partition, in the order it reads them, and holds only the documents that wait
for a place. A document longer than the largest context gives full windows; the rest of it, like any shorter document, is
routed to the smallest context size that holds it. Each size is packed from the largest down: a document opens a
window, whole documents of shorter sizes fill the gap (the largest that fits first), and the last bit is cut from a
shorter document, or from the next one of the same size, whose rest is routed again. What is left at the end of a
partition is cut at powers of two, so no sequence is padded. Step groups join sequences of one context size up to an
equal number of tokens.

There is no shuffle and no shared state; a lost task repeats the same packing from the same rows.

Defined results: a null or empty text is the end token alone; repeated rows are packed each; an empty table gives no
pieces; a text of any length is cut as it is placed.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.bpe import in_chunks, library_encoder
from tidepanel.llm.common import slices, tokenizer_path

TIERS = (64, 128, 256, 512, 1024)
END_ID = 0
PARTITION_SHIFT = 40


class Packer:
    """Packs documents as they come. A document is [key, ids as bytes, next token, tokens]."""

    def __init__(self, tiers=TIERS, step_tokens: int = 8192, first_sequence: int = 0):
        self.tiers = tuple(sorted(tiers))
        self.most = self.tiers[-1]
        self.pools: list[deque] = [deque() for _ in self.tiers]
        self.step_tokens = step_tokens
        self.sequence = first_sequence
        self.first = first_sequence
        self.made: dict[int, int] = {}
        self.out: list[tuple] = []

    def _route(self, doc: list) -> None:
        left = doc[3] - doc[2]
        if left:
            for pool, size in zip(self.pools, self.tiers):
                if left <= size:
                    pool.append(doc)
                    return

    def add(self, key, ids: bytes) -> None:
        doc = [key, ids, 0, len(ids) // 4]
        while doc[3] - doc[2] >= self.most:
            self._emit([(doc, doc[2], self.most)])
            doc[2] += self.most
        self._route(doc)

    def _take(self, doc: list, room: int) -> tuple:
        length = min(room, doc[3] - doc[2])
        piece = (doc, doc[2], length)
        doc[2] += length
        return piece

    def _emit(self, pieces: list[tuple]) -> None:
        size = sum(p[2] for p in pieces)
        number = self.made.get(size, 0)
        self.made[size] = number + 1
        group = number // max(1, self.step_tokens // size)
        offset = 0
        for doc, start, length in pieces:
            checksum = zlib.crc32(memoryview(doc[1])[4 * start : 4 * (start + length)])
            self.out.append((doc[0], start, length, checksum, doc[3], self.sequence, offset, size, self.first + group))
            offset += length
        self.sequence += 1

    def drain(self) -> None:
        """Pack all full windows of what waits; the largest size first, so that it may use the shorter documents."""
        for tier in range(len(self.tiers) - 1, -1, -1):
            waiting = sum(d[3] - d[2] for pool in self.pools[: tier + 1] for d in pool)
            while self.pools[tier] and waiting >= self.tiers[tier]:
                pieces = self._window(tier)
                waiting -= self.tiers[tier]
                self._emit(pieces)

    def _window(self, tier: int) -> list[tuple]:
        size = self.tiers[tier]
        pieces = [self._take(self.pools[tier].popleft(), size)]
        gap = size - pieces[0][2]
        while gap:
            fitting = (p for p in reversed(self.pools[:tier]) if p and p[0][3] - p[0][2] <= gap)
            pool = next(fitting, None) or next(p for p in self.pools[: tier + 1] if p)
            doc = pool.popleft()
            pieces.append(self._take(doc, gap))
            gap -= pieces[-1][2]
            self._route(doc)
        return pieces

    def finish(self) -> None:
        """Cut the rest at powers of two, the largest first."""
        rest = deque(d for pool in reversed(self.pools) for d in pool)
        left = sum(d[3] - d[2] for d in rest)
        while left:
            size = min(self.most, 1 << (left.bit_length() - 1))
            pieces, gap = [], size
            while gap:
                pieces.append(self._take(rest[0], gap))
                gap -= pieces[-1][2]
                if rest[0][2] == rest[0][3]:
                    rest.popleft()
            self._emit(pieces)
            left -= size

    def rows(self) -> list[tuple]:
        done, self.out = self.out, []
        return done


FIELDS = (
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()),
    ("offset", pa.int64()),
    ("context", pa.int32()),
    ("step_group", pa.int64()),
)
KINDS = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, context int, step_group bigint"


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = 8192,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece of a document: where it is cut and where it lies.

    ``context`` is the size of the sequence; a step group is unique together with it and holds about ``step_tokens``.
    """
    place = path or tokenizer_path()
    end = end_id.to_bytes(4, "little")
    base = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << PARTITION_SHIFT)
        encoder = library_encoder(place)
        id_type = None

        def table(rows):
            columns = list(zip(*rows)) or [()] * (len(FIELDS) + 1)
            arrays = [pa.array(columns[0], id_type)]
            arrays += [pa.array(c, kind) for c, (_, kind) in zip(columns[1:], FIELDS)]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", *[n for n, _ in FIELDS]])

        for batch in (part for whole in batches for part in slices(whole)):
            id_type = batch.schema.field("doc_id").type
            ids = iter(batch.column(0).to_pylist())
            for texts in in_chunks([t or "" for t in batch.column(1).to_pylist()]):
                for encoded in encoder.encode(texts):
                    packer.add(next(ids), encoded + end)
                packer.drain()
                yield table(packer.rows())
        if id_type is not None:
            packer.finish()
            yield table(packer.rows())

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, {KINDS}")
