"""Stage tables: where lineage is cut, and joins that know NULL keys.

Two rules hold all over the library:

* no side of a join is broadcast by hand, Spark does it from measured sizes;
* a table read by several branches whose values must be bit-equal in all of
  them is written once to the shared checkpoint folder (:func:`freeze`).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder for stage tables: the session's checkpoint folder, which all executors must reach.

    Only where none is set and driver and executors are one local process, a folder of its own.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidepanel-"))
    return context.getCheckpointDir()


def stage_folder(spark: SparkSession) -> str:
    """The folder of this application's stage tables."""
    return f"{shared_folder(spark).rstrip('/')}/tidepanel/{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, name: str = "stage") -> str:
    """A fresh path below the application's stage folder."""
    return f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_stages(spark: SparkSession) -> None:
    """Remove all stage tables of this application; results not yet written can no longer be read then."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def freeze(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as a stage table and read it back.

    Later branches read the same values (a float sum recomputed in another order
    may differ in its last bit), only the columns they need, and survive the loss
    of executors without recomputing what came before.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# plan nodes that give the same rows, value by value, whenever they are read again
REREAD = {"Project", "Filter", "LogicalRelation", "Relation", "LocalRelation", "SubqueryAlias", "Union"}
REPEAT = {"Expand", "Generate"}  # several rows from one, which cost less to make again than to store

MOST_JOINS = 2  # with small tables that are made again rather than stored; more of them cost more than a stage table


def reads_alike(df: DataFrame) -> bool:
    """Whether ``df`` only projects, filters and unpivots stored rows, so that reading it again gives the same values.

    It may join them to stored tables that are small enough to be broadcast, such as statistics of groups: then no row is
    shuffled again, and less is read than a wider table would be written and read.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if not plan.deterministic():
        return False
    small = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    nodes, joins = [plan], 0
    while nodes:
        node = nodes.pop()
        kind = node.nodeName().split(" ")[0]
        if kind == "Join":
            joins += 1
            if joins > MOST_JOINS or int(node.children().apply(1).stats().sizeInBytes()) > small:
                return False
        elif kind not in REREAD | REPEAT:
            return False
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return True


def settled(df: DataFrame, name: str = "section") -> DataFrame:
    """``df`` as a stage table; itself if reading it again gives the same values anyway."""
    return df if reads_alike(df) else freeze(df, name)


TASK_BYTES = 8 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` into a partition per ``TASK_BYTES`` of the stored tables it is made from, at least one per core;
    into Spark's own number where rows are not read from stored tables.

    A shuffle of Spark's own choice is merged until a task reads 64 MB of compressed rows, whose sorts and windows take many
    times that; the number given here is kept, so the memory of one task stays the same when the input grows.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    unknown = df.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes()
    leaves = plan.collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    if any(size >= unknown for size in sizes):  # rows that are not stored
        return df.repartition(*keys)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-sum(sizes) // TASK_BYTES)), *keys)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the right key columns are dropped."""
    renamed = right.select(
        *[F.col(key).alias(f"_r_{key}") if key in keys else F.col(key) for key in right.columns]
    )
    condition = F.lit(True)
    for position, key in enumerate(keys):
        match = left[key].eqNullSafe(renamed[f"_r_{key}"])
        condition = match if position == 0 else condition & match
    return left.join(renamed, condition, how).drop(*[f"_r_{key}" for key in keys])
