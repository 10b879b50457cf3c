"""Classes of execution errors and their counts per model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_label, strip

# The error classes.
ERROR_TYPES = [
    "SQL Syntax Errors",
    "PostGIS Function Errors",
    "Missing Objects",
    "Result Mismatch Errors",
    "Geometry Parsing Errors",
    "SRID/Dimension Mismatch",
    "Environment/Connection Errors",
]
FALLBACK = "Environment/Connection Errors"

# Phrases of each class, tried in this order on the lower-case message.
_RULES = [
    ("SRID/Dimension Mismatch", r"mixed srid|srid mismatch|dimension mismatch|different srid"),
    (
        "Geometry Parsing Errors",
        r"parse error|invalid geometr|cannot mix dimensionality|requires more points"
        r"|geometry contains non-closed|invalid (?:ewkt|wkt|wkb|hex)",
    ),
    (
        "Result Mismatch Errors",
        r"row count mismatch|expected \d+ rows?,? (?:but )?got|column subset match failed",
    ),
    (
        "PostGIS Function Errors",
        r"(?:function|operator) .*(?:does not exist|is not unique)|argument (?:count|type)"
        r"|missing required (?:parameter|clause)|no function matches",
    ),
    (
        "Missing Objects",
        r"(?:relation|table|view|column|schema|type|alias) .*does not exist|missing from-clause",
    ),
    ("SQL Syntax Errors", r"syntax error|unterminated|mismatched input|unexpected token"),
]


def whitelist_label(label: Column | str) -> Column:
    """One of the classes, compared without case; all else is the environment class."""
    given = F.lower(strip(F.col(label) if isinstance(label, str) else label))
    table = F.create_map(*[F.lit(x) for t in ERROR_TYPES for x in (t.lower(), t)])
    return F.coalesce(F.try_element_at(table, given), F.lit(FALLBACK))


def error_class(message: Column | str) -> Column:
    """Class of a message by the phrases that define the classes; null for a blank one."""
    text = F.lower(strip(F.col(message) if isinstance(message, str) else message))
    rules = F.when(text.isNull() | (text == ""), F.lit(None).cast("string"))
    for label, phrases in _RULES:
        rules = rules.when(F.regexp_like(text, F.lit(phrases)), label)
    return rules.otherwise(FALLBACK)


def classify_errors(
    df: DataFrame, source: str = "execution_error", response: str | None = None
) -> DataFrame:
    """Add ``error_type`` for every non-blank message.

    ``response`` names a column with a model's answer to the error prompt; its label is
    cleaned and checked. Without it the phrases decide.
    """
    if response is None:
        return df.withColumn("error_type", error_class(source))
    asked = F.coalesce(strip(F.col(source)), F.lit("")) != ""
    return df.withColumn("error_type", F.when(asked, whitelist_label(clean_label(response))))


def error_prefix_counts(df: DataFrame, error: str = "error") -> DataFrame:
    """How often each text before the first colon occurs."""
    prefix = strip(F.substring_index(F.col(error), ":", 1))
    filled = F.coalesce(F.col(error), F.lit("")) != ""
    return df.where(filled).groupBy("model", prefix.alias("prefix")).agg(F.count("*").alias("n"))


def error_counts(df: DataFrame) -> DataFrame:
    """(model, error_type, count), the most common first."""
    filled = F.coalesce(strip(F.col("error_type")), F.lit("")) != ""
    return (
        df.where(filled)
        .groupBy("model", "error_type")
        .agg(F.count("*").alias("count"))
        .orderBy("model", F.col("count").desc(), "error_type")
    )


def error_long(counts: DataFrame, names: DataFrame) -> DataFrame:
    """Long report with display names, in category and display order.

    ``names``: (model, category, name, name_ord); names without an order come last.
    """
    lookup = names.select("model", "category", "name", "name_ord")
    return (
        counts.join(lookup, "model", "inner")
        .orderBy("category", F.asc_nulls_last("name_ord"), F.col("count").desc(), "error_type")
        .select("category", "name", "error_type", "count")
    )


def error_pivot(
    counts: DataFrame,
    names: DataFrame,
    rows: str = "type",
    error_types: Sequence[str] = tuple(ERROR_TYPES),
    heads: Sequence[str] | None = None,
) -> DataFrame:
    """Zero-filled table of classes x models (``rows="type"``) or models x classes.

    ``rows="model"`` shows every listed model, also one without errors. ``rows="type"`` has a column
    for each display name in ``heads``, in that order; without ``heads`` Spark looks up the names of
    the models with errors. ``error_long`` has the same cells as rows.
    """
    lookup = names.select("model", "category", "name", "name_ord")
    if rows == "model":
        listed = lookup.join(counts, "model", "left")
        cells = [
            F.coalesce(F.sum(F.when(F.col("error_type") == t, F.col("count"))), F.lit(0)).alias(t)
            for t in sorted(error_types)
        ]
        return (
            listed.groupBy("category", "name", "name_ord")
            .agg(*cells)
            .orderBy("category", F.asc_nulls_last("name_ord"))
            .drop("name_ord")
        )
    joined = counts.join(lookup, "model", "inner")
    return (
        joined.groupBy("error_type")
        .pivot("name", None if heads is None else list(heads))
        .agg(F.sum("count"))
        .na.fill(0)
        .orderBy("error_type")
    )
