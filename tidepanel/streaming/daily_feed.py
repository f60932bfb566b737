"""Daily files as they arrive: the incremental load as a file stream.

Instead of polling a folder for files newer than the last one loaded, the
stream's checkpoint remembers which files were read, each run takes what is new
and stops, and a restarted run neither skips nor repeats a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidepanel.sources.readers import SOURCE_FILE, path_date


def new_daily_rows(spark: SparkSession, folder: str, schema: StructType | str, start=None, end=None, **options) -> DataFrame:
    """Streaming rows of delimited daily files with their file and the date in its path."""
    rows = spark.readStream.schema(schema).options(header=True, **options).csv(folder)
    rows = rows.withColumn(SOURCE_FILE, F.col("_metadata.file_path"))
    rows = rows.withColumn("file_date", path_date(SOURCE_FILE))
    if start is not None:
        rows = rows.where(F.col("file_date") >= F.lit(str(start)).cast("date"))
    if end is not None:
        rows = rows.where(F.col("file_date") <= F.lit(str(end)).cast("date"))
    return rows


def append_new_files(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append everything that has arrived since the last run, then stop."""
    return (
        rows.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
