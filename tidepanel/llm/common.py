"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TOKENIZER_FILE = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    """Default place of a public tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def slices(batch, rows: int = 256):
    """Short runs of an Arrow batch, so that only a few rows at a time become Python objects."""
    for start in range(0, max(len(batch), 1), rows):
        yield batch.slice(start, rows)


def with_text_result(
    df: DataFrame, text_col: str, function: Callable[[list], list], schema: str, name: str
) -> DataFrame:
    """``df`` and a struct column ``name``: ``function`` of a list of texts gives a list of tuples.

    Rows keep their place, so nothing is joined or shuffled and any other column passes untouched.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = list(to_arrow_schema(StructType.fromDDL(schema)))

    def over(texts: pa.Array) -> pa.Array:
        done = [_columns(function(part.to_pylist()), fields) for part in slices(texts)]
        whole = [pa.concat_arrays(parts) for parts in zip(*done)]
        return pa.StructArray.from_arrays(whole, fields=fields)

    over.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return df.withColumn(name, F.arrow_udf(over, schema)(F.col(f"`{text_col}`").cast("string")))


def _columns(rows: list, fields: list) -> list:
    import pyarrow as pa

    columns = list(zip(*rows)) or [()] * len(fields)
    return [pa.array(c, f.type) for c, f in zip(columns, fields)]


def crc32_of_id(column: str) -> Column:
    """crc32 of the decimal form of an id (a missing id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
