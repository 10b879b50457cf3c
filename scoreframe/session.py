"""Session helpers: settings for scoring jobs and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of the machine:
    on a cluster executors would not see it.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="scoreframe-")
        spark.conf.set(CHECKPOINT_CONF, base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result must be the same in every later use (an order taken
    from a sort, a user callable) and must survive the loss of executors.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Deal the rows over all cores by ``keys``, a few tasks for each and ``least`` in all.

    For work that takes long per row: a table of a few million short rows lies in one file or a few
    row groups, and so few tasks would do it all.
    """
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, least), *keys)


#: Rows of a sort that one task gets, about.
ROWS_PER_TASK = 1 << 20


def tasks_for(df: DataFrame) -> int:
    """Tasks among which to shuffle ``df``: the session's number, or more where each would get too many rows.

    Counts the rows, so that the memory of a task doesn't grow with the table.
    """
    return tasks_of(df.sparkSession, df.count())


def tasks_of(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))
