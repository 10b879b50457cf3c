"""Scores per model. Every metric takes ``by`` as its grouping columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_answer, type_key
from .order import dealt, first_n_of, running_index

BY = ("model",)


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _ratio(hit: Column, total: Column, digits: int) -> Column:
    """Rounded share; 0 of 0 is 0."""
    return F.round(F.coalesce(F.try_divide(hit, total), F.lit(0.0)), digits)


# --- choice questions ----------------------------------------------------------------------


def judged(df: DataFrame, kind: str = "mcq") -> DataFrame:
    """Add ``correct``: true, false, or null where a failed or blank answer is skipped."""
    pred = norm_answer("pred_answer", "tf")
    usable = ~_filled("error") & (pred != "")
    same = norm_answer("pred_answer", kind) == norm_answer("gold_answer", kind)
    return df.withColumn("correct", F.when(usable, same))


def accuracy(
    df: DataFrame, answer: str = "mcq", by: Sequence[str] = BY, per_type: bool = False
) -> DataFrame:
    """Correct, incorrect and skipped answers and the accuracy of the answered ones.

    ``per_type`` adds one row per question type; the overall row has type ``OVERALL``. Both
    levels come from one aggregation: the types are counted, then summed up.
    """
    marked = judged(df, answer)
    counts = [
        F.count_if("correct").alias("correct_count"),
        F.count_if(~F.col("correct")).alias("incorrect_count"),
        F.count_if(F.col("correct").isNull()).alias("skipped_count"),
    ]
    score = _ratio(
        F.col("correct_count"), F.col("correct_count") + F.col("incorrect_count"), 6
    ).alias("accuracy")
    if not per_type:
        return marked.groupBy(*by).agg(*counts).select("*", score)
    typed = marked.groupBy(*by, type_key("type").alias("type")).agg(*counts)
    level = F.explode(F.array_distinct(F.array(F.col("type"), F.lit("OVERALL"))))
    names = ["correct_count", "incorrect_count", "skipped_count"]
    return (
        typed.withColumn("type", level)
        .groupBy(*by, "type")
        .agg(*[F.sum(n).alias(n) for n in names])
        .where((F.col("correct_count") + F.col("incorrect_count") > 0) | (F.col("type") == "OVERALL"))
        .select("*", score)
    )


def accuracy_wide(per_type: DataFrame, types: Sequence[str], by: Sequence[str] = BY) -> DataFrame:
    """Flat form: ``overall_...`` then ``<TYPE>_correct_count``, ``_incorrect_count``,
    ``_accuracy`` of the given types, sorted."""
    metrics = ["correct_count", "incorrect_count", "accuracy"]
    cols = [
        F.max(F.when(F.col("type") == t, F.col(m))).alias(f"{label}_{m}")
        for t, label in [("OVERALL", "overall"), *[(t, t) for t in sorted(types)]]
        for m in metrics
    ]
    return per_type.groupBy(*by).agg(*cols)


# --- repeated rounds ---------------------------------------------------------------------


def pass_at_k(
    df: DataFrame,
    ks: Sequence[int] = (1, 3, 5),
    by: Sequence[str] = BY,
    item: Sequence[str] = ("id",),
    order: Sequence[str] = ("round", "ord"),
    positional: bool = False,
    group: int = 5,
    parts: int | None = None,
) -> DataFrame:
    """Share of items with a correct result among their first k rounds.

    Only the first max(ks) rounds of an item leave the map tasks; in a table of many rows for each shuffle
    task, those of frequent items only (see :func:`.order.dealt`). ``positional`` groups
    ``group`` consecutive rows in ``order`` instead and drops an incomplete last group;
    ``parts`` is the number of stretches of a numeric order that tasks number apart.
    """
    hit = F.coalesce(F.col("result_correct") == "correct", F.lit(False))

    def passes(groups: DataFrame, unit: Sequence[str]) -> DataFrame:
        return groups.groupBy(*unit).agg(
            F.count("*").alias("_n"),
            *[F.max((F.col("rn") <= k) & F.col("_hit")).alias(f"_p{k}") for k in ks],
        )

    if positional:
        numbered = running_index(df, by, order, "_idx", parts)
        groups = numbered.select(
            *by,
            F.floor((F.col("_idx") - 1) / group).alias("_group"),
            ((F.col("_idx") - 1) % group + 1).alias("rn"),
            hit.alias("_hit"),
        )
        passed = passes(groups, [*by, "_group"]).where(F.col("_n") == group)
    else:
        unit = [*by, *item]
        # Only what counts is shuffled and sorted. Each part adds up its own items, which need no other shuffle.
        rows = df.select(*unit, *[c for c in order if c not in unit], hit.alias("_hit"))
        passed = reduce(
            DataFrame.unionByName, [passes(first_n_of(part, unit, order, max(ks)), unit) for part in dealt(rows, unit)]
        )
    return passed.groupBy(*by).agg(
        F.count("*").alias("num_samples"),
        *[F.count_if(f"_p{k}").alias(f"pass_{k}_count") for k in ks],
        *[F.round(F.count_if(f"_p{k}") / F.count("*"), 4).alias(f"pass@{k}") for k in ks],
    )


def stability(rates: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Add the variation of the pass rates and the accuracy it discounts.

    The coefficient of variation is taken over the rates of all k (not within the last).
    A mean of 0 gives an infinite one and accuracy 0.
    """
    cols = [F.col(f"`pass@{k}`") for k in ks]
    n = F.lit(float(len(cols)))
    mean = sum(cols[1:], cols[0]) / n
    deviations = [(c - mean) * (c - mean) for c in cols]
    sd = F.sqrt(sum(deviations[1:], deviations[0]) / n)
    cv = F.when(mean == 0, F.lit(float("inf"))).otherwise(F.round(F.try_divide(sd, mean), 4))
    last = F.col(f"`pass@{ks[-1]}`")
    return rates.withColumn(f"pass@{ks[-1]}_std_cv", cv).withColumn(
        "stability_adjusted_accuracy",
        F.when(mean == 0, 0.0).otherwise(
            F.lit(100.0) * F.round(last / (F.lit(1.0) + F.col(f"`pass@{ks[-1]}_std_cv`")), 4)
        ),
    )


# --- execution, semantics and resources --------------------------------------------------------


def execution_summary(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Statements and columns that pass, with their shares.

    Columns are counted inside each row first, so one aggregation serves both levels.
    ``st_equals_z``: text equality, or shape and Z equality, each column once.
    """
    cols = F.filter(
        F.zip_with(
            "column_type",
            "result_comparison",
            lambda t, c: F.struct(t.alias("t"), c.alias("c")),
        ),
        lambda z: z["t"].isNotNull() & z["c"].isNotNull(),
    )
    geom = lambda z: z["t"] == "geometry"
    text = lambda z: z["t"] == "text"
    astext = lambda z: geom(z) & z["c"]["column_pass_by_st_astext"]
    equals_z = lambda z: geom(z) & (
        z["c"]["column_pass_by_st_equals"] & z["c"]["column_pass_by_st_z"]
    )
    value = lambda z: text(z) & z["c"]["column_pass_by_value_match"]
    count = lambda test: F.coalesce(F.size(F.filter("_cols", test)), F.lit(0))
    per_row = df.select(
        *by,
        F.coalesce("executable", F.lit(False)).alias("_exec"),
        F.coalesce(F.col("result_correct") == "correct", F.lit(False)).alias("_right"),
        cols.alias("_cols"),
    ).select(
        *by,
        "_exec",
        "_right",
        F.coalesce(F.size("_cols"), F.lit(0)).alias("_n"),
        count(geom).alias("_geom"),
        count(text).alias("_text"),
        count(astext).alias("_astext"),
        count(lambda z: astext(z) | equals_z(z)).alias("_eqz"),
        count(value).alias("_value"),
    )
    total = lambda c: F.sum(c).cast("bigint")
    sums = per_row.groupBy(*by).agg(
        F.count("*").alias("total_sql"),
        F.count_if("_exec").alias("executable_sql_count"),
        F.count_if("_right").alias("correct_sql_count"),
        total("_n").alias("total_columns"),
        total("_geom").alias("geometry_columns"),
        total("_text").alias("text_columns"),
        total("_astext").alias("st_astext_column_pass"),
        total("_eqz").alias("st_equals_z_column_pass"),
        total("_value").alias("value_match_column_pass"),
    )
    share = lambda a, b: _ratio(F.col(a), F.col(b), 4)
    return sums.withColumns(
        {
            "correct_sql_ratio": share("correct_sql_count", "total_sql"),
            "executable_sql_ratio": share("executable_sql_count", "total_sql"),
            "geometry_st_astext_pass_ratio": share("st_astext_column_pass", "geometry_columns"),
            "geometry_st_equals_z_pass_ratio": share("st_equals_z_column_pass", "geometry_columns"),
            "text_value_match_pass_ratio": share("value_match_column_pass", "text_columns"),
        }
    )


def resource_usage(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Time and tokens per model.

    ``average_duration_sec`` divides by one less than the samples (null for a single one),
    ``mean_duration_sec`` by the samples.
    """
    n = F.count("*")
    duration = F.coalesce(F.sum("duration"), F.lit(0.0))
    tokens = F.coalesce(F.sum("tokens_used"), F.lit(0)).cast("bigint")
    return df.groupBy(*by).agg(
        n.alias("sample_count"),
        F.round(duration, 3).alias("total_duration_sec"),
        F.round(F.try_divide(duration, n - 1), 3).alias("average_duration_sec"),
        F.round(F.try_divide(duration, n), 3).alias("mean_duration_sec"),
        tokens.alias("total_tokens_used"),
        F.round(F.try_divide(tokens, n), 3).alias("average_tokens_per_sample"),
    )


def semantic_summary(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Shares of valid statements and found functions and the mean type match.

    A found function without any fitting overload (ratio 0) is left out of the mean;
    ``avg_ratio_all`` includes it.
    """
    ratio = F.col("param_type_match_ratio")
    counted = F.when(~(F.col("function_hit") & (ratio == 0)), ratio)
    n = F.count("*")
    return df.groupBy(*by).agg(
        n.alias("total"),
        F.count_if("structure_valid").alias("structure_valid_count"),
        F.count_if("function_hit").alias("function_hit_count"),
        F.round(F.count_if("structure_valid") / n, 4).alias("structure_valid_ratio"),
        F.round(F.count_if("function_hit") / n, 4).alias("function_hit_ratio"),
        F.round(F.coalesce(F.avg(counted), F.lit(0.0)), 4).alias("avg_param_type_match_ratio"),
        F.round(F.coalesce(F.avg(ratio), F.lit(0.0)), 4).alias("avg_ratio_all"),
    )
