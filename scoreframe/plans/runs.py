"""Runs against models: generating predictions and labelling their errors, both resumable."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import errors as X
from ..operators import prompts as P
from ..operators import runs as R
from ..sources import append_runs


def generate_runs(
    items: DataFrame,
    models: Mapping[str, Callable],
    rounds: int,
    store: str,
    done: DataFrame | None = None,
    key: Sequence[str] = ("id", "function", "question"),
    **calls: object,
) -> None:
    """Ask every model for every item ``rounds`` times and append the answers to ``store``.

    Items have the columns of ``key``. Tasks whose model and key are in ``done`` are left out, so
    a run that broke off goes on where it stopped. ``calls`` go to ``batch_predict``. The models are
    separate services: one job each, named by the mapping.
    """
    for model, fn in models.items():
        tasks = R.expand_rounds(items, rounds, [model])
        tasks = tasks.withColumn("unique_key", R.unique_key(*key, "round"))
        if done is not None:
            tasks = R.pending(tasks, done, ["model", "unique_key"])
        asked = tasks.withColumn("prompt", P.prompt_sql(F.col("question")))
        append_runs(R.as_stored(R.batch_predict(asked, fn, **calls)).drop("prompt"), store)


def label_errors(
    records: DataFrame,
    store: str,
    done: DataFrame | None = None,
    fn: Callable | None = None,
    key: Sequence[str] = ("model", "unique_key"),
    max_chars: int | None = None,
    **calls: object,
) -> None:
    """Append the error class of each record with a message to ``store``; those in ``done`` are left out.

    ``fn`` is asked with the error prompt (the message cut to ``max_chars``); without it the phrases
    that define the classes decide.
    """
    failed = records.where(F.coalesce(F.trim("execution_error"), F.lit("")) != "")
    if done is not None:
        failed = R.pending(failed, done, key, F.col("error_type").isNotNull())
    if fn is None:
        labelled = X.classify_errors(failed)
    else:
        prompt = P.prompt_error(F.col("execution_error"), max_chars)
        answers = R.batch_predict(failed.withColumn("prompt", prompt), fn, **calls)
        labelled = X.classify_errors(answers, response="response")
    append_runs(labelled.select(*records.columns, "error_type"), store)


def error_reports(
    labelled: DataFrame, names: DataFrame, heads: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """Counts per model and class, the long report and both tables of classes and models."""
    counts = X.error_counts(labelled)
    return {
        "counts": counts,
        "long": X.error_long(counts, names),
        "by_type": X.error_pivot(counts, names, heads=heads),
        "by_model": X.error_pivot(counts, names, rows="model"),
    }
