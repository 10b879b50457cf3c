"""Row order, first and last rows, and running positions.

An order key is any sortable column, usually the struct of ``with_ingest_order``.
Work that needs neighbours is done inside stretches of that order, and only
one summary row per stretch is brought together, so a group of any size is
spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import session
from ..session import tasks_for, tasks_of

#: Keys that are looked for as frequent ones, at most, and how many a sketch follows.
_FREQUENT, _FOLLOWED = 1000, 10_000


def with_stretch(df: DataFrame, ord_col: str, parts: int | None = None) -> DataFrame:
    """Add ``_stretch``, the stretch of the order a row lies in: its file block, or one of
    ``parts`` ranges of numbers with about the same number of rows.

    The ranges are cut at quantiles of the data, as many as there are shuffle partitions
    unless ``parts`` says otherwise. Equal numbers share a stretch.
    """
    if isinstance(df.schema[ord_col].dataType, T.StructType):
        return df.withColumn("_stretch", F.struct(F.col(ord_col)["file"], F.col(ord_col)["block"]))
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.approxQuantile(ord_col, [k / n for k in range(1, n)], 1 / (4 * n)) if n > 1 else []
    if not cuts:
        return df.withColumn("_stretch", F.lit(0.0))
    bounds = [-math.inf, *sorted(set(cuts)), math.inf]
    number = df.withColumn("_number", F.col(ord_col).cast("double"))
    cut = Bucketizer(splits=bounds, inputCol="_number", outputCol="_stretch", handleInvalid="keep")
    return cut.transform(number).drop("_number")


def is_sorted_within(
    df: DataFrame,
    keys: Sequence[str],
    by: str = "round",
    ord_col: str = "ord",
    parts: int | None = None,
) -> DataFrame:
    """(keys, is_sorted): whether ``by`` never falls within a group along the order."""
    near = Window.partitionBy(*keys, "_stretch").orderBy(ord_col)
    dealt = with_stretch(df, ord_col, parts).select(*keys, "_stretch", by, ord_col)
    # Both windows and both aggregations go by these or by the keys alone.
    dealt = dealt.repartition(tasks_for(df.select(*keys)), *keys, "_stretch")
    steps = dealt.select(
        *keys,
        "_stretch",
        F.col(by).alias("_by"),
        F.col(ord_col).alias("_ord"),
        (F.col(by) >= F.coalesce(F.lag(by).over(near), F.col(by))).alias("_ok"),
    )
    stretches = steps.groupBy(*keys, "_stretch").agg(
        F.bool_and("_ok").alias("_ok"),
        F.min_by("_by", "_ord").alias("_first"),
        F.max_by("_by", "_ord").alias("_last"),
    )
    far = Window.partitionBy(*keys).orderBy("_stretch")
    joined = stretches.withColumn(
        "_ok",
        F.col("_ok")
        & (F.col("_first") >= F.coalesce(F.lag("_last").over(far), F.col("_first"))),
    )
    return joined.groupBy(*keys).agg(F.bool_and("_ok").alias("is_sorted"))


def reorder_runs(
    df: DataFrame,
    keys: Sequence[str] = ("id", "function", "question"),
    by: str = "round",
    ord_col: str = "ord",
) -> DataFrame:
    """Global order by group and round; equal rounds keep their file order."""
    return df.orderBy(*keys, by, ord_col)


def dedup_first(
    df: DataFrame, key: str = "unique_key", within: Sequence[str] = ("model",), ord_col: str = "ord"
) -> DataFrame:
    """First row per key; rows without a key are dropped.

    The rank limit is applied in every input partition first, so a key that repeats
    millions of times sends one row per partition.
    """
    w = Window.partitionBy(*within, key).orderBy(ord_col)
    return (
        df.where(F.coalesce(F.col(key), F.lit("")) != "")
        .withColumn("_rn", F.row_number().over(w))
        .where("_rn = 1")
        .drop("_rn")
    )


def last_per_key(df: DataFrame, keys: Sequence[str], ord_col: str = "ord", ties: Sequence[str] = ()) -> DataFrame:
    """Last row per key; rows with a null key are dropped. Of rows that tie, the least by ``ties`` stays."""
    w = Window.partitionBy(*keys).orderBy(F.col(ord_col).desc(), *ties)
    return (
        df.dropna(subset=list(keys))
        .withColumn("_rn", F.row_number().over(w))
        .where("_rn = 1")
        .drop("_rn")
    )


def dealt(df: DataFrame, keys: Sequence[str]) -> list[DataFrame]:
    """Parts of ``df``, each with all rows of its keys, for work per key that a task does within its rows.

    A table that fits the session's number of shuffle tasks is one part, as it is. A larger one is shuffled by the
    keys among as many tasks as it needs, so that the memory of a task doesn't grow with the table. Keys that hold
    a large part of a task's rows each are left apart as they are: what limits or adds up rows before a shuffle
    still does so for them. Which keys these are is estimated and changes no result.
    """
    key = F.xxhash64(*keys)
    spark = df.sparkSession
    counted = df.select(key.alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(k, {_FREQUENT}, {_FOLLOWED})").alias("top")
    )
    found = counted.first()
    n = tasks_of(spark, found["n"])
    if n <= tasks_of(spark, 0):
        return [df]
    often = [t["item"] for t in found["top"] if t["count"] > session.ROWS_PER_TASK // 4]
    if not often:
        return [df.repartition(n, *keys)]
    return [df.where(~key.isin(often)).repartition(n, *keys), df.where(key.isin(often))]


def first_n_of(part: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, name: str = "rn") -> DataFrame:
    """:func:`first_n` of rows as they are dealt."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return part.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def first_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, name: str = "rn"
) -> DataFrame:
    """First ``n`` rows per group with their position; limited before the shuffle, or see :func:`dealt`."""
    parts = [first_n_of(part, keys, order, n, name) for part in dealt(df, keys)]
    return reduce(DataFrame.unionByName, parts)


def running_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "idx",
    parts: int | None = None,
) -> DataFrame:
    """Position 1.. of each row in its group along ``order`` (its first column cuts stretches).

    Rows are numbered inside a stretch; the rows in front of a stretch come from
    the per-stretch counts.
    """
    n = tasks_for(df.select(*keys))
    df = with_stretch(df, order[0], parts).repartition(n, *keys, "_stretch")
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        df.groupBy(*keys, "_stretch")
        .count()
        .select(
            *keys,
            "_stretch",
            F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"),
        )
    )
    near = Window.partitionBy(*keys, "_stretch").orderBy(*order)
    return (
        df.join(offsets, [*keys, "_stretch"])
        .withColumn(name, F.col("_before") + F.row_number().over(near))
        .drop("_before", "_stretch")
    )


def dedup_columns(columns: DataFrame, keys: Sequence[str] = ("query_id", "side")) -> DataFrame:
    """Distinct column names of a result: c, c_1, c_2 ... in column order."""
    w = Window.partitionBy(*keys, "col_name").orderBy("col_idx")
    seen = F.row_number().over(w) - 1
    return columns.withColumn(
        "col_name",
        F.when(seen > 0, F.concat_ws("_", "col_name", seen.cast("string"))).otherwise(
            F.col("col_name")
        ),
    )
