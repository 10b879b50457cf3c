"""Lookups of item metadata, gold records, signatures and display names.

No side is forced to be broadcast: Spark does so by itself below its size
threshold, and AQE splits a hot join key otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread, tasks_for
from .order import last_per_key
from .refs import parse_schema

MISSING_SCHEMA = "Missing schema_text for this id"
MISSING_SQL = "Missing pred_sql"
MISSING_FUNCTION = "Missing function_name (id->new_id mapping or fallback failed)"
MISSING_PAIR = "missing pred_sql / gold_sql / db_id"


def _filled(c: Column | str) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def attach_db(df: DataFrame, items: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Add the item's ``db_id`` (null when the id is unknown); the last item of an id counts."""
    lookup = last_per_key(items, ["new_id"], ord_col).select(
        F.col("new_id").alias("id"), F.col("db_id")
    )
    return df.drop("db_id").join(lookup, "id", "left")


def attach_schema(
    df: DataFrame, items: DataFrame, ord_col: str = "ord", parse: bool = False
) -> DataFrame:
    """Add the item's schema text and a ``schema_error`` where it has none.

    ``parse`` adds its ``catalog`` instead, parsed once per schema text; items find it by the text's
    digest, so their texts are not shuffled. Reading texts takes long per row, so the schema texts and
    the rows of ``df`` are then dealt over all cores. Rows without id or SQL are dropped.
    """
    column = "catalog" if parse else "schema"
    given = items.where(_filled("schema").isNotNull())
    if parse:
        digest = F.unhex(F.sha2(F.col("schema").cast("binary"), 256)).alias("_digest")
        schemas = spread(given.select("schema").distinct().select("schema", digest), "_digest")
        catalogs = parse_schema(schemas).select("_digest", "catalog")
        texts = last_per_key(given.select("new_id", ord_col, digest), ["new_id"], ord_col).join(catalogs, "_digest")
    else:
        texts = last_per_key(given, ["new_id"], ord_col)
    lookup = texts.select(F.col("new_id").alias("id"), F.col(column), F.lit(True).alias("_known"))
    usable = df.where(F.col("id").isNotNull() & _filled("pred_sql").isNotNull())
    if parse:
        usable = spread(usable, "id", least=tasks_for(df.select("id")))
    return (
        usable.join(lookup, "id", "left")
        .withColumn("schema_error", F.when(F.col("_known").isNull(), F.lit(MISSING_SCHEMA)))
        .drop("_known")
    )


def attach_function(df: DataFrame, items: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Add ``function_name_used``: the item's, else the record's own; and ``semantic_error``."""
    named = items.withColumn(
        "_fn", F.coalesce(_filled("metadata.function_name"), _filled("metadata.function"))
    ).where("_fn IS NOT NULL")
    lookup = last_per_key(named, ["new_id"], ord_col).select(
        F.col("new_id").alias("id"), F.col("_fn")
    )
    own = [_filled(c) for c in ("function_name", "function") if c in df.columns]
    return (
        df.join(lookup, "id", "left")
        .withColumn("function_name_used", F.coalesce(F.col("_fn"), *own))
        .drop("_fn")
        .withColumn(
            "semantic_error",
            F.when(_filled("pred_sql").isNull(), F.lit(MISSING_SQL)).when(
                F.col("function_name_used").isNull(), F.lit(MISSING_FUNCTION)
            ),
        )
    )


def join_gold(pred: DataFrame, gold: DataFrame, key: str = "id") -> DataFrame:
    """Predictions next to the gold record of their id; ids on one side only are skipped."""
    return pred.join(gold, key, "inner")


def guard_pairs(df: DataFrame) -> DataFrame:
    """Mark rows that lack predicted SQL, gold SQL or database as ``error``."""
    missing = F.coalesce(
        _filled("pred_sql").isNull()
        | _filled("gold_sql").isNull()
        | _filled(F.trim("db_id")).isNull(),
        F.lit(True),
    )
    return df.withColumns(
        {
            "execution_error": F.when(missing, F.lit(MISSING_PAIR)).otherwise(F.lit("")),
            "result_correct": F.when(missing, F.lit("error")),
        }
    )


def normalize_models(df: DataFrame, names: DataFrame) -> DataFrame:
    """Replace raw model names by (category, name); models not in the list are skipped."""
    lookup = names.select("model", "category", "name")
    return df.join(lookup, "model", "inner")
