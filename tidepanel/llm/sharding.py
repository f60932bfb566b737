"""Jump consistent hashing: shards of rows by a stable key, in expressions only.

A row's shard follows from its key and the number of shards. The key drives a generator whose numbers say at which shard
count the row would move next; the last move below the present count is its shard. With one more shard a row either stays
or moves into the new one. No table of shards is kept, and no row needs another row.

The place of a row inside its shard (``slot``) is gapless: equal rows are counted first, (shard, bucket) counts give the
first slot of each bucket, rows are numbered inside buckets. A bucket holds one in 4096 of a shard's distinct rows, so no
task numbers a whole shard.

Defined results: a missing key is replaced by a hash of the text; a null text has no bytes (size 1, checksum 0); repeated
rows share a shard and take neighbouring slots; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import read

# Fixed values of the published generator
MULTIPLIER, INCREMENT = 2862933555777941757, 1
BUCKETS = 4096
SHARDS = 16


def next_number(key: Column, multiplier: int = MULTIPLIER, increment: int = INCREMENT) -> Column:
    """key * multiplier + increment modulo 2**64, in quarters of 16 bits, which never overflow a 64-bit number."""
    k = [F.shiftrightunsigned(key, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("bigint")) for i in range(4)]
    m = [multiplier >> (16 * i) & 0xFFFF for i in range(4)]
    carry: Column = F.lit(increment).cast("bigint")
    out: Column | None = None
    for i in range(4):
        total = carry
        for j in range(i + 1):
            total = total + k[j] * F.lit(m[i - j]).cast("bigint")
        part = F.shiftleft(total.bitwiseAND(F.lit(0xFFFF).cast("bigint")), 16 * i)
        out = part if out is None else out.bitwiseOR(part)
        carry = F.shiftright(total, 16)
    return out


def jump(key: Column, shards: int) -> tuple[Column, Column]:
    """Shard of a 64-bit key among ``shards`` and among one more."""

    def once(s: Column, number: Column) -> Column:
        wide = (F.shiftrightunsigned(number, 33) + F.lit(1)).cast("double")
        target = F.floor((s["at"] + 1).cast("double") * (F.lit(float(1 << 31)) / wide))
        return F.struct(
            number.alias("key"),
            F.when(target <= shards, target).otherwise(s["at"]).cast("bigint").alias("at"),
            F.when(target < shards, target).otherwise(s["low"]).cast("bigint").alias("low"),
            (target <= shards).alias("open"),
        )

    def step(s: Column, _: Column) -> Column:
        moved = F.element_at(F.transform(F.array(next_number(s["key"])), lambda n: once(s, n)), 1)
        return F.when(s["open"], moved).otherwise(s)

    zero = F.lit(0).cast("bigint")
    first = F.struct(key.cast("bigint").alias("key"), zero.alias("at"), zero.alias("low"), F.lit(True).alias("open"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), first, step)
    return last["low"].cast("int"), last["at"].cast("int")


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Shard, slot and the shard among one more, with size and checksum of each row's text."""
    data = F.col(text_col).cast("string").cast("binary")
    key = F.col(id_col)
    if df.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        key = F.when(key.isNotNull(), F.xxhash64(key.cast("string")))
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.length(data), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(data), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.coalesce(key.cast("bigint"), F.xxhash64(data)).alias("key"),
    )
    kinds = rows.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count("*").alias("copies"))
    low, grown = jump(F.col("key"), shards)
    spread = next_number(F.col("key").bitwiseXOR(F.col("text_crc32")), MULTIPLIER ^ (1 << 40))
    kinds = kinds.withColumns({"shard": low, "grown_shard": grown, "bucket": F.shiftrightunsigned(spread, 52)})
    # at most shards x BUCKETS rows
    counts = kinds.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "key")
    place = place.rowsBetween(Window.unboundedPreceding, 0)
    kinds = kinds.withColumn("end", F.sum("copies").over(place)).join(F.broadcast(counts), ["shard", "bucket"])
    last = F.col("first") + F.col("end") - 1
    kinds = kinds.withColumn("slot", F.explode(F.sequence(last - F.col("copies") + 1, last)))
    return kinds.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint"), "grown_shard"
    )


def shard_documents(spark, sf: str) -> DataFrame:
    return shard(read(spark, sf, "documents"))
