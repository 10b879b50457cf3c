"""Running gold and predicted queries and keeping their results as cells."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sqltext import order_spec
from ..session import shared_dir

_STATUS = (
    "query_id STRING, side STRING, executable BOOLEAN, error STRING, execution_time DOUBLE, "
    "col_names ARRAY<STRING>"
)


def run_pairs(
    spark: SparkSession, pairs: Iterable[tuple[str, str, str]]
) -> tuple[DataFrame, DataFrame]:
    """Run (query_id, gold_sql, pred_sql) over the views of the session.

    Returns (cells, status). The driver only submits the queries, each result is
    written by its tasks to the shared folder. The same text is run once. A
    failing query gives a status row with its error and no cells; the other query of
    the pair runs all the same. ``ordered`` in the status says whether the text asks for an
    order; without one, compare with ``multiset_compare``. There is no time limit, and a
    text that changes data would be run as well: use a session that may only read.
    """
    base = shared_dir(spark, "pairs")
    seen: dict[str, int] = {}
    runs: list[tuple] = []
    uses: list[tuple] = []
    for query_id, gold_sql, pred_sql in pairs:
        for side, sql in (("gold", gold_sql), ("pred", pred_sql)):
            if sql not in seen:
                seen[sql] = len(seen)
                runs.append((seen[sql], *_run_one(spark, sql, f"{base}/run={seen[sql]}")))
            uses.append((str(query_id), side, seen[sql], sql))
    status = (
        spark.createDataFrame(uses, "query_id STRING, side STRING, run INT, sql STRING")
        .join(
            spark.createDataFrame(
                runs,
                "run INT, executable BOOLEAN, error STRING, execution_time DOUBLE, "
                "col_names ARRAY<STRING>",
            ),
            "run",
        )
        .withColumn("ordered", F.size(order_spec("sql")) > 0)
        .drop("sql")
    )
    if not any(r[1] for r in runs):
        cells = spark.createDataFrame(
            [], "query_id STRING, side STRING, row_idx BIGINT, col_idx INT, col_name STRING, value STRING"
        )
        return cells, status.drop("run")
    stored = spark.read.schema("vals ARRAY<STRING>, pos BIGINT, run INT").parquet(base)
    cells = (
        _with_row_index(stored)
        .join(status.select("run", "query_id", "side", "col_names"), "run")
        .select(
            "query_id",
            "side",
            "row_idx",
            "col_names",
            F.posexplode("vals").alias("col_idx", "value"),
        )
        .select(
            "query_id",
            "side",
            "row_idx",
            "col_idx",
            F.get("col_names", F.col("col_idx")).alias("col_name"),
            "value",
        )
    )
    return cells, status.drop("run")


def _run_one(spark: SparkSession, sql: str, path: str) -> tuple:
    start = time.time()
    try:
        result = spark.sql(sql.strip().rstrip(";"))
        names = result.columns
        plain = result.toDF(*[f"_{i}" for i in range(len(names))])
        vals = F.array(*[F.col(c).cast("string") for c in plain.columns])
        plain.select(vals.alias("vals"), F.monotonically_increasing_id().alias("pos")).write.parquet(
            path
        )
        return True, None, round(time.time() - start, 6), names
    except PySparkException as e:
        return False, str(e).split("\n\nJVM stacktrace")[0], round(time.time() - start, 6), []


def _with_row_index(stored: DataFrame) -> DataFrame:
    """Dense row numbers from the stored positions: the upper bits are the task, the lower
    the row in it, so only per-task counts have to be summed up."""
    task = F.shiftright("pos", 33)
    before = Window.partitionBy("run").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("run", task.alias("task"))
        .count()
        .select("run", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    )
    row = F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        stored.withColumn("task", task)
        .join(offsets, ["run", "task"])
        .select("run", "vals", (F.col("before") + row).alias("row_idx"))
    )
