"""Scores per model."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics as M
from .registry import from_view, query
from .text import TOKEN, TOLERANT

ANSWER = f"regexp_extract(right({TOLERANT.replace('raw', 'raw_answer')}, 240), {TOKEN}, 1)"
KEY = "trim(regexp_replace(upper(type), '[^A-Z0-9]+', '_', 'g'), '_')"
# Answers with their judgement: null = skipped.
MCQ = f"""SELECT model, {KEY} AS type, CASE WHEN error IS NULL AND a <> '' THEN upper(a) = g END AS ok FROM (
  SELECT *, {ANSWER} AS a, CASE WHEN gold_answer LIKE '%,%' THEN 'B,A' ELSE gold_answer END AS g FROM $answers)"""
TF = f"""SELECT model, {KEY} AS type, CASE WHEN error IS NULL AND a <> '' THEN upper(a) = g END AS ok FROM (
  SELECT *, {ANSWER} AS a, CASE WHEN id % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS g FROM $answers)"""
SCORES = """count(*) FILTER (WHERE ok) AS correct_count, count(*) FILTER (WHERE NOT ok) AS incorrect_count, count(*) FILTER (WHERE ok IS NULL) AS skipped_count,
  round(coalesce(CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / nullif(count(ok), 0), 0), 6) AS accuracy"""
BY_TYPE = f"""SELECT model, coalesce(type, 'OVERALL') AS type, {SCORES} FROM ({MCQ}) GROUP BY GROUPING SETS ((model, type), (model)) HAVING count(ok) > 0 OR type IS NULL"""


def _answers(spark, sf):
    return from_view(spark, sf, "answers").withColumn("pred_answer", X.final_answer("raw_answer"))


@query("accuracy_mcq", "O99", f"SELECT model, {SCORES} FROM ({MCQ}) GROUP BY model")
def accuracy_mcq(spark, sf):
    return M.accuracy(_answers(spark, sf))


@query("accuracy_tf", "O100", f"SELECT model, {SCORES} FROM ({TF}) GROUP BY model")
def accuracy_tf(spark, sf):
    gold = F.when(F.col("id") % 2 == 0, " True").otherwise("fALSE ")
    return M.accuracy(_answers(spark, sf).withColumn("gold_answer", gold), "tf")


@query("accuracy_by_type", "O101", BY_TYPE)
def accuracy_by_type(spark, sf):
    return M.accuracy(_answers(spark, sf), per_type=True)


TYPES = [f"{lang}_{toxic}" for lang in ("DE", "EN", "ES", "FR") for toxic in (0, 1, 9)]


@query(
    "accuracy_wide",
    "O101",
    "SELECT model, " + ", ".join(
        f'max({m}) FILTER (WHERE type = \'{t}\') AS "{label}_{m}"'
        for t, label in [("OVERALL", "overall"), *[(t, t) for t in TYPES]]
        for m in ("correct_count", "incorrect_count", "accuracy")
    ) + f" FROM ({BY_TYPE}) GROUP BY model",
)
def accuracy_wide(spark, sf):
    return M.accuracy_wide(accuracy_by_type(spark, sf), TYPES)


def _passes(groups: str) -> str:
    return f"""SELECT model, count(*) AS num_samples, count(*) FILTER (WHERE p1) AS pass_1_count, count(*) FILTER (WHERE p3) AS pass_3_count, count(*) FILTER (WHERE p5) AS pass_5_count,
  round(CAST(count(*) FILTER (WHERE p1) AS DOUBLE) / count(*), 4) AS "pass@1", round(CAST(count(*) FILTER (WHERE p3) AS DOUBLE) / count(*), 4) AS "pass@3", round(CAST(count(*) FILTER (WHERE p5) AS DOUBLE) / count(*), 4) AS "pass@5"
FROM ({groups}) GROUP BY model"""


def _groups(numbered: str, unit: str, extra: str = "") -> str:
    return f"""SELECT model, bool_or(rn <= 1 AND hit) AS p1, bool_or(rn <= 3 AND hit) AS p3, bool_or(rn <= 5 AND hit) AS p5 FROM ({numbered}) GROUP BY model, {unit} {extra}"""


NUMBERED = """SELECT model, id, result_correct = 'correct' AS hit, row_number() OVER (PARTITION BY model, id ORDER BY round, ord) AS rn FROM $runs"""
PASSES = _passes(_groups(NUMBERED, "id"))
POSITIONAL = """SELECT model, (i - 1) // 5 AS grp, (i - 1) % 5 + 1 AS rn, result_correct = 'correct' AS hit FROM (
  SELECT model, result_correct, row_number() OVER (PARTITION BY model ORDER BY ord, id) AS i FROM $runs)"""


def _pass(spark, sf):
    return M.pass_at_k(from_view(spark, sf, "runs"))


@query("pass_at_k", "O102", PASSES)
def pass_at_k(spark, sf):
    return _pass(spark, sf)


@query(
    "pass_at_k_positional", "O102", _passes(_groups(POSITIONAL, "grp", "HAVING count(*) = 5"))
)
def pass_at_k_positional(spark, sf):
    runs = from_view(spark, sf, "runs")
    return M.pass_at_k(runs, order=("ord", "id"), positional=True)


@query(
    "stability",
    "O103",
    f"""SELECT *, CASE WHEN cv = 'Infinity' THEN 0.0 ELSE 100.0 * round("pass@5" / (1 + cv), 4) END AS stability_adjusted_accuracy FROM (
  SELECT *, CASE WHEN mu = 0 THEN CAST('Infinity' AS DOUBLE) ELSE round(sqrt((("pass@1" - mu) ** 2 + ("pass@3" - mu) ** 2 + ("pass@5" - mu) ** 2) / 3) / mu, 4) END AS cv
  FROM (SELECT *, ("pass@1" + "pass@3" + "pass@5") / 3 AS mu FROM ({PASSES})))""",
)
def stability(spark, sf):
    return M.stability(_pass(spark, sf)).withColumns(
        {"mu": (F.col("`pass@1`") + F.col("`pass@3`") + F.col("`pass@5`")) / 3}
    ).withColumnRenamed("pass@5_std_cv", "cv")


COLUMNS = """named_struct('column_pass_by_st_astext', {a}, 'column_pass_by_st_equals', {e}, 'column_pass_by_st_z', {z}, 'column_pass_by_value_match', {v})"""
RESULT = (
    "CASE WHEN round < 6 THEN array("
    + COLUMNS.format(a="executable", e="function = 'ST_F'", z="round > 2", v="false")
    + ", "
    + COLUMNS.format(a="false", e="false", z="false", v="tokens_used % 3 = 0")
    + ") END"
)


@query(
    "execution_summary",
    "O104",
    """SELECT *, round(CAST(correct_sql_count AS DOUBLE) / total_sql, 4) AS correct_sql_ratio, round(CAST(executable_sql_count AS DOUBLE) / total_sql, 4) AS executable_sql_ratio,
  round(CAST(st_astext_column_pass AS DOUBLE) / geometry_columns, 4) AS geometry_st_astext_pass_ratio, round(CAST(st_equals_z_column_pass AS DOUBLE) / geometry_columns, 4) AS geometry_st_equals_z_pass_ratio,
  round(CAST(value_match_column_pass AS DOUBLE) / text_columns, 4) AS text_value_match_pass_ratio FROM (
  SELECT model, count(*) AS total_sql, count(*) FILTER (WHERE executable) AS executable_sql_count, count(*) FILTER (WHERE result_correct = 'correct') AS correct_sql_count,
    CAST(2 * count(*) FILTER (WHERE round < 6) AS BIGINT) AS total_columns, count(*) FILTER (WHERE round < 6) AS geometry_columns, count(*) FILTER (WHERE round < 6) AS text_columns,
    count(*) FILTER (WHERE round < 6 AND executable) AS st_astext_column_pass, count(*) FILTER (WHERE round < 6 AND (executable OR (function = 'ST_F' AND round > 2))) AS st_equals_z_column_pass,
    count(*) FILTER (WHERE round < 6 AND tokens_used % 3 = 0) AS value_match_column_pass FROM $runs GROUP BY model)""",
)
def execution_summary(spark, sf):
    rows = from_view(spark, sf, "runs").select(
        "model",
        "executable",
        "result_correct",
        F.expr("CASE WHEN round < 6 THEN array('geometry', 'text') END").alias("column_type"),
        F.expr(RESULT).alias("result_comparison"),
    )
    return M.execution_summary(rows)
