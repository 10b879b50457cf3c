"""Append and resume as a stream: new prediction files are added to a store once per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.order import dealt, dedup_first


def follow_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stream of prediction files that appear below ``path``."""
    return spark.readStream.schema(schema).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a store is there, asked of the file system of its path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _unstored(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in a store, which has each key once."""
    return rows.join(done.select("model", key), ["model", key], "left_anti")


def append_new(
    stream: DataFrame, store: str, checkpoint: str, key: str = "unique_key", ord_col: str = "ord", parts: int = 64
) -> StreamingQuery:
    """Append what is not stored yet, for all files there are now, to a Parquet store.

    The first row of a key within a batch stays. A batch that is repeated after a failure finds
    its keys stored and adds nothing, so a key is never stored twice. The store is partitioned
    by a hash of the key into ``parts`` folders, and a batch reads the model and key columns of
    those it may write to. Any error but a missing store ends the stream.

    A batch is shuffled once: the folders are known from its keys alone, and the join with the stored keys goes by
    what the first rows went by.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        # Parts that need no other shuffle; most batches are one.
        keyed = batch.where(F.coalesce(F.col(key), F.lit("")) != "")
        split = dealt(keyed, ["model", key])
        firsts = [dedup_first(rows, key, ord_col=ord_col) for rows in split]
        if _exists(spark, store):
            done = spark.read.schema(firsts[0].withColumn("part", _part(key, parts)).schema).parquet(store)
            if split[0] is keyed:
                # At most ``parts`` numbers; they prune the folders that are read. A larger batch writes to all.
                touched = [r["part"] for r in keyed.select(_part(key, parts).alias("part")).distinct().collect()]
                done = done.where(F.col("part").isin(touched))
            firsts = [_unstored(rows, done, key) for rows in firsts]
        fresh = reduce(DataFrame.unionByName, firsts).withColumn("part", _part(key, parts))
        fresh.write.mode("append").partitionBy("part").parquet(store)

    return (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
