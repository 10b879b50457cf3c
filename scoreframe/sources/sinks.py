"""JSON-Lines, summary, CSV and report sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Records of a compressed file, which is read by one task, at most.
_PACKED = 1 << 20


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """One JSON object per row, null keys kept, non-ASCII text as it is; ``compression`` as Spark names it."""
    sink = df.write.mode(mode).option("ignoreNullFields", False)
    if compression:
        sink = sink.option("compression", compression).option("maxRecordsPerFile", _PACKED)
    sink.json(path)


def write_summary(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per model under ``path/model=<name>``."""
    df.repartition("model").write.mode(mode).option("ignoreNullFields", False).partitionBy(
        "model"
    ).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; a sorted frame keeps its order over the part files."""
    df.write.mode(mode).option("header", True).csv(path)


def report_table(df: DataFrame, first: Sequence[str] = ("model",)) -> DataFrame:
    """Report shape: the leading columns first, the others in given order, sorted by row key."""
    rest = [c for c in df.columns if c not in first]
    return df.select(*[F.col(f"`{c}`") for c in [*first, *rest]]).orderBy(
        *[F.col(f"`{c}`") for c in first]
    )


def append_runs(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Add new results to a JSON-Lines folder; the job commits all of its files or none."""
    write_jsonl(df, path, mode="append", compression=compression)
