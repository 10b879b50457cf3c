"""Whole evaluations, put together from the operators.

Every step takes all models at once. A prediction is named by ``keys`` (its model and unique
key, or a query id) all the way.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.text import extract_sql, final_answer
from ..operators import calls as K
from ..operators import cells as C
from ..operators import enrich as E
from ..operators import metrics as M
from ..operators import refs as R
from ..operators.order import dedup_first
from ..operators.report import merge_summaries
from ..session import materialize


def prepare_answers(predictions: DataFrame) -> DataFrame:
    """Knowledge level: raw answers to choices."""
    return predictions.withColumn("pred_answer", final_answer("pred_answer"))


def score_answers(predictions: DataFrame, kind: str = "mcq", per_type: bool = True) -> DataFrame:
    """Knowledge level: accuracy per model and question type."""
    return M.accuracy(prepare_answers(predictions), kind, per_type=per_type)


def prepare_sql(predictions: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """SQL levels: first row per key, then the SQL of each answer, then its database.

    Duplicates go first: they need no cleaning.
    """
    cleaned = dedup_first(predictions).withColumn("pred_sql", extract_sql("pred_sql"))
    return cleaned if items is None else E.attach_db(cleaned, items)


# What a query's run may report, with the value of a run that reports nothing.
STATUS = {
    "executable": True, "execution_time": 0.0, "gold_executable": True, "gold_execution_time": 0.0,
    "gold_error": "", "pred_error": "",
}


def query_gate(
    cells: DataFrame, keys: Sequence[str], queries: DataFrame | None, table_level: bool
) -> DataFrame:
    """One row per query with its status, row counts and, where those decide, its result.

    ``queries`` lists all queries, also those without any cell: keys, optional columns of
    ``STATUS``, ``pred_sql``, ``gold_sql`` and ``db_id`` (all three or none), and any others, which are
    kept. Rows without SQL or database are errors; where a query failed, or there is nothing on
    either side, the result is unknown.
    """
    counts = C.row_counts(cells, keys)
    if queries is not None:
        counts = queries.join(counts, list(keys), "left").fillna(0, ["pred_rows", "gold_rows"])
    known = {n: F.coalesce(n, F.lit(v)) if n in counts.columns else F.lit(v) for n, v in STATUS.items()}
    counts = counts.withColumns(known)
    ran = F.col("executable") & (F.col("gold_executable") | F.lit(not table_level))
    gate = C.row_count_gate(counts, table_level, F.col("gold_executable"))
    gate = gate.withColumns(
        {
            "result_correct": F.when(~ran, F.lit("unknown")).otherwise(F.col("result_correct")),
            "execution_error": F.when(~ran, F.lit("")).otherwise(F.col("execution_error")),
        }
    )
    if {"pred_sql", "gold_sql", "db_id"} <= set(gate.columns):
        kept = gate.withColumnsRenamed({"result_correct": "_result", "execution_error": "_error"})
        guarded = E.guard_pairs(kept)
        bad = F.col("result_correct").isNotNull()
        gate = guarded.withColumns(
            {
                "executable": F.col("executable") & ~bad,
                "execution_error": F.when(bad, F.col("execution_error")).otherwise(F.col("_error")),
                "result_correct": F.coalesce("result_correct", "_result"),
            }
        ).drop("_result", "_error")
    return gate


COLUMN_FIELDS = [
    "ST_AsText_pass", "ST_Equals_pass", "ST_Z_pass", "value_match_pass", "total_rows",
    "column_pass_by_st_astext", "column_pass_by_st_equals", "column_pass_by_st_z",
    "column_pass_by_value_match", "column_type",
]
PASS_RATES = ["st_astext", "st_equals", "st_z", "value_match"]


def execution_records(
    gate: DataFrame,
    stats: DataFrame,
    verdicts: DataFrame | None = None,
    keys: Sequence[str] = C.KEYS,
) -> DataFrame:
    """One record per query of ``gate``: its status, verdict, message, column results and pass rates.

    Without ``verdicts`` all columns have to pass. One aggregation of ``stats`` gives verdict, rates
    and columns together. A query that isn't compared, or whose columns find no counterparts, has
    an empty comparison and rates of 0.
    """
    names = [*COLUMN_FIELDS, *[c for c in ("pred_col", "gold_col") if c in stats.columns]]
    rate = lambda c: F.round(F.count_if(f"column_pass_by_{c}") / F.count("*"), 4).alias(c)
    per_query = stats.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("col_idx", *names))).alias("_cols"),
        F.bool_and(C.column_ok()).alias("_right"),
        F.struct(*[rate(c) for c in PASS_RATES]).alias("_rates"),
    )
    joined = gate.join(per_query, list(keys), "left")
    verdict = F.when(F.col("_right"), "correct").when(~F.col("_right"), "incorrect")
    message, whole = F.lit(None).cast("string"), F.lit(True)
    if verdicts is not None:
        found = verdicts.withColumnsRenamed({"result_correct": "_verdict", "execution_error": "_message"})
        joined = joined.join(found, list(keys), "left")
        verdict, message = F.col("_verdict"), F.col("_message")
        whole = F.coalesce(verdict == "correct", F.lit(False))
    cols = F.when(whole, F.col("_cols"))
    none = F.struct(*[F.lit(0.0).alias(c) for c in PASS_RATES])
    skip = {*keys, "result_correct", "execution_error"}
    shown = F.transform(cols, lambda c: F.struct(*[c[n].alias(n) for n in names]))
    return joined.select(
        *keys,
        *[c for c in gate.columns if c not in skip],
        F.coalesce("result_correct", verdict, F.lit("unknown")).alias("result_correct"),
        F.coalesce(F.nullif("execution_error", F.lit("")), message, F.lit("")).alias("execution_error"),
        F.coalesce(F.transform(cols, lambda c: c["column_type"]), F.array().cast("array<string>")).alias("column_type"),
        F.coalesce(shown, F.from_json(F.lit("[]"), _array_of(stats, names))).alias("result_comparison"),
        F.coalesce(F.when(whole, F.col("_rates")), none).alias("strategy_pass_rate"),
    )


def _array_of(stats: DataFrame, names: Sequence[str]) -> ArrayType:
    return ArrayType(StructType([stats.schema[n] for n in names]))


def score_expected(
    cells: DataFrame, keys: Sequence[str] = C.KEYS, queries: DataFrame | None = None
) -> DataFrame:
    """Syntax level: predicted results against stored ones, place by place.

    ``queries`` (see ``query_gate``) keeps queries without cells; without it the cells name the queries.
    """
    gate = query_gate(cells, keys, queries, table_level=False)
    stats = C.column_stats(C.compare_positional(C.comparable(cells, gate, keys), keys), keys)
    return execution_records(gate, stats, None, keys)


def score_matched(
    cells: DataFrame, keys: Sequence[str] = C.KEYS, queries: DataFrame | None = None
) -> DataFrame:
    """Table-schema level: every predicted column needs an equal gold column.

    ``queries`` (see ``query_gate``) keeps queries without cells and tells which ones failed.
    """
    gate = query_gate(cells, keys, queries, table_level=True)
    passed = C.comparable(cells, gate, keys)
    prints = materialize(C.column_prints(passed, keys), "prints")
    matches = C.match_columns(passed, keys, prints)
    stats = C.with_column_passes(matches.withColumn("col_idx", F.col("pred_col")))
    return execution_records(gate, stats, C.subset_verdict(prints, matches, keys), keys)


def score_semantics(
    predictions: DataFrame, items: DataFrame, signatures: DataFrame, keys: Sequence[str],
    returns: DataFrame | None = None,
) -> DataFrame:
    """SQL levels: does the SQL call the item's function with fitting argument types."""
    return K.score_calls(E.attach_function(predictions, items), signatures, keys, returns)


def score_references(predictions: DataFrame, items: DataFrame, gold: DataFrame) -> DataFrame:
    """Table-schema level: recall of the gold tables and columns per model."""
    with_catalog = E.attach_schema(predictions, items, parse=True)
    picked = R.pick_refs(with_catalog.where("schema_error IS NULL"))
    return R.hit_rates(picked, gold, ord_col="ord")


def model_report(
    results: DataFrame,
    semantics: DataFrame | None = None,
    hits: DataFrame | None = None,
    extra: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """One wide row per model from scored predictions.

    The predictions are stored first, with the columns that count, so that what leads to them
    (dropping duplicates, comparing results) is worked out once for all parts.
    """
    names = {
        "model", "id", "round", "ord", "executable", "result_correct", "column_type", "result_comparison",
        "tokens_used", "duration", "start_time", "timestamp",
    }
    results = materialize(results.select(*[c for c in results.columns if c in names]), "results")
    parts = {
        "execution": M.execution_summary(results),
        "with_passn": M.stability(M.pass_at_k(results)),
        "resource": M.resource_usage(results),
    }
    if semantics is not None:
        parts["semantic_pgtype"] = M.semantic_summary(semantics)
    if hits is not None:
        parts["hits"] = hits
    return merge_summaries({**parts, **(extra or {})})
