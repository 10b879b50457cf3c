"""One wide row per model from several summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_summaries(summaries: Mapping[str, DataFrame], key: str = "model") -> DataFrame:
    """Outer merge by model, columns named ``prefix.column``; missing stays null.

    Each summary has one row per model, so they are stacked and folded in one shuffle.
    """
    stacked = None
    for prefix, df in summaries.items():
        renamed = df.select(
            key, *[F.col(f"`{c}`").alias(f"{prefix}.{c}") for c in df.columns if c != key]
        )
        stacked = (
            renamed
            if stacked is None
            else stacked.unionByName(renamed, allowMissingColumns=True)
        )
    cols = [c for c in stacked.columns if c != key]
    return stacked.groupBy(key).agg(
        *[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in cols]
    )
