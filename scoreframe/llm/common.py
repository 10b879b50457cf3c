"""Small helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.session import materialize as stored
from scoreframe.session import shared_dir

__all__ = ["stored", "shared_dir", "lower_az", "LOWER", "LOWER_BYTES", "UPPER", "texts", "segments", "table", "keep_rows"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: For ``bytes.translate``: lower case for A-Z only, every other byte as it is.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def lower_az(text: Column) -> Column:
    """Lower case for A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value, null as empty, without making Python strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    if data is None:
        yield from (b"" for _ in range(len(column)))
        return
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data)
    # A null's slot spans no bytes in arrays that Spark sends.
    for start, end, valid in zip(at, at[1:], column.is_valid().to_pylist(), strict=False):
        yield bytes(view[start:end]) if valid else b""


def segments(data: bytes, size: int = 1 << 20, breaks: bytes = b" ") -> Iterator[bytes]:
    """Cut a text behind a break byte about every ``size`` bytes, to bound what a long one needs."""
    start = 0
    while len(data) - start > size:
        ends = [e for b in breaks if (e := data.find(bytes([b]), start + size)) >= 0]
        if not ends:
            break
        end = min(ends) + 1
        yield data[start:end]
        start = end
    yield data[start:]


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str, digest: Column) -> DataFrame:
    """The rows of ``docs`` that ``decided`` keeps, with all their columns.

    ``decided`` has a row for each row of ``docs``: ``_id``, ``_digest`` (of the text) and ``_keep``.
    Rows that repeat both id and digest are one row here: kept once, or not at all.
    """
    keys = decided.groupBy("_id", "_digest").agg(F.count(F.lit(1)).alias("_n"), F.max("_keep").alias("_keep"))
    keys = stored(keys.where("_keep").select("_id", "_digest", "_n"), "keep")
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].alias("_id"), digest.alias("_digest")
    )
    found = rows.alias("r").join(keys.alias("k"), F.expr("r._id <=> k._id AND r._digest = k._digest"))
    found = found.select("r._row", "r._id", "r._digest", "k._n")
    once = found.where("_n = 1").select("_row")
    again = found.where("_n > 1").groupBy("_id", "_digest").agg(F.first("_row").alias("_row")).select("_row")
    return once.unionByName(again).select("_row.*")
