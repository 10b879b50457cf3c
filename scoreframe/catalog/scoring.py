"""Whole evaluations."""

from pyspark.sql import functions as F

from .. import plans as P
from .cells import COUNTS, EQUAL
from .metrics import BY_TYPE, PASSES
from ..operators import prompts as PR
from ..session import shared_dir
from .errors import NAMED
from .registry import from_view, query, spark_sql
from .runs import WS, text_sql


@query("score_answers", "O30 O31 O32 O41 O101", BY_TYPE)
def score_answers(spark, sf):
    answers = from_view(spark, sf, "answers").withColumnRenamed("raw_answer", "pred_answer")
    return P.score_answers(answers)


BAD7, Q5 = "q % 3 = 1 AND n >= 8", "q % 6 = 5"


@query(
    "score_expected",
    "O58 O65 O73 O75 O77 O78",
    f"""SELECT 'q' || q AS query_id, CASE WHEN bad7 OR q5 OR q % 4 = 3 THEN 'incorrect' ELSE 'correct' END AS result_correct, '' AS execution_error,
  CASE WHEN q5 THEN 'text,text' ELSE 'text,geometry' END AS column_type, CAST(CASE WHEN bad7 THEN 0.0 ELSE 0.5 END AS DOUBLE) AS value_match,
  CAST(CASE WHEN q5 OR q % 4 = 2 THEN 0.0 WHEN q % 4 = 3 THEN 0.0 ELSE 0.5 END AS DOUBLE) AS st_astext, CAST(CASE WHEN q5 THEN 0.0 ELSE 0.5 END AS DOUBLE) AS st_equals,
  CAST(CASE WHEN q5 OR q % 4 = 3 THEN 0.0 ELSE 0.5 END AS DOUBLE) AS st_z, n AS total_rows
FROM (SELECT q, {BAD7} AS bad7, {Q5} AS q5, n FROM (SELECT q, max(row_idx) + 1 AS n FROM $grid GROUP BY q))""",
)
def score_expected(spark, sf):
    records = P.score_expected(from_view(spark, sf, "placed"))
    rates = [F.col(f"strategy_pass_rate.{c}").alias(c) for c in P.PASS_RATES]
    return records.select(
        "query_id",
        "result_correct",
        "execution_error",
        F.array_join("column_type", ",").alias("column_type"),
        *rates,
        F.col("result_comparison")[0]["total_rows"].cast("int").alias("total_rows"),
    )


MATCHED = f"""SELECT k.query_id, CASE WHEN p <> g OR coalesce(m, 0) < 2 THEN 'incorrect' ELSE 'correct' END AS result_correct, p, g
FROM ({COUNTS}) k LEFT JOIN (SELECT query_id, count(DISTINCT pc) AS m FROM ({EQUAL}) GROUP BY 1) e ON k.query_id = e.query_id"""


@query(
    "score_matched",
    "O64 O65 O76 O77 O78",
    f"SELECT query_id, result_correct, CAST(CASE WHEN result_correct = 'correct' THEN 2 ELSE 0 END AS INTEGER) AS matched FROM ({MATCHED})",
)
def score_matched(spark, sf):
    records = P.score_matched(from_view(spark, sf, "cells"))
    return records.select("query_id", "result_correct", F.size("result_comparison").alias("matched"))


# All queries of a run: some failed, some lack SQL, some have no cells at all.
RUN = """SELECT query_id, concat('m', CAST(q % 3 AS STRING)) AS model, q % 5 <> 4 AS executable, q % 9 <> 8 AS gold_executable,
  CASE WHEN q % 13 <> 12 THEN 'SELECT 1' END AS pred_sql, 'SELECT 1' AS gold_sql, CASE WHEN q % 17 = 16 THEN ' ' ELSE 'db' END AS db_id,
  CAST(q AS DOUBLE) AS execution_time FROM (SELECT DISTINCT query_id, q FROM $grid)
UNION ALL SELECT concat('empty', CAST(n_nationkey AS STRING)), 'm0', true, true, 'SELECT 1', 'SELECT 1', 'db', 0.5 FROM @nation"""
RECORDS = f"""SELECT r.*, CASE WHEN pred_sql IS NULL OR trim(db_id) = '' THEN 'error' WHEN NOT executable OR NOT gold_executable OR m.query_id IS NULL THEN 'unknown' ELSE result_correct END AS verdict
FROM ({RUN}) r LEFT JOIN ({MATCHED}) m ON r.query_id = m.query_id"""


@query(
    "score_records",
    "O63 O64 O65 O76 O77 O78",
    f"""SELECT query_id, model, executable AND verdict <> 'error' AS executable, execution_time, verdict AS result_correct,
  CASE WHEN verdict = 'correct' THEN '0:1,1:0' ELSE '' END AS pairs, CASE WHEN verdict = 'correct' THEN 'text,text' ELSE '' END AS column_type,
  CASE WHEN verdict = 'error' THEN 'missing pred_sql / gold_sql / db_id' ELSE '' END AS guard, CAST(CASE WHEN verdict = 'correct' THEN 1 ELSE 0 END AS DOUBLE) AS value_match FROM ({RECORDS})""",
)
def score_records(spark, sf):
    records = P.score_matched(from_view(spark, sf, "cells"), queries=spark_sql(spark, sf, RUN))
    pairs = F.transform("result_comparison", lambda c: F.concat_ws(":", c["pred_col"].cast("string"), c["gold_col"].cast("string")))
    return records.select(
        "query_id", "model", "executable", "execution_time", "result_correct", F.array_join(pairs, ",").alias("pairs"),
        F.array_join("column_type", ",").alias("column_type"),
        F.when(F.col("result_correct") == "error", F.col("execution_error")).otherwise("").alias("guard"),
        F.col("strategy_pass_rate.value_match").alias("value_match"),
    )


@query(
    "score_to_summary",
    "O63 O64 O65 O76 O104",
    f"""SELECT model, count(*) AS total_sql, count(*) FILTER (WHERE executable AND verdict <> 'error') AS executable_sql_count, count(*) FILTER (WHERE verdict = 'correct') AS correct_sql_count,
  CAST(2 * count(*) FILTER (WHERE verdict = 'correct') AS BIGINT) AS total_columns, CAST(2 * count(*) FILTER (WHERE verdict = 'correct') AS BIGINT) AS value_match_column_pass,
  round(CAST(count(*) FILTER (WHERE verdict = 'correct') AS DOUBLE) / count(*), 4) AS correct_sql_ratio FROM ({RECORDS}) GROUP BY model""",
)
def score_to_summary(spark, sf):
    from ..operators import metrics as M

    records = P.score_matched(from_view(spark, sf, "cells"), queries=spark_sql(spark, sf, RUN))
    return M.execution_summary(records).select(
        "model", "total_sql", "executable_sql_count", "correct_sql_count", "total_columns", "value_match_column_pass", "correct_sql_ratio"
    )


@query(
    "score_semantics",
    "O54 O81 O82 O83 O87",
    """SELECT id, id % 10 IN (1, 8, 9) AS structure_valid, id % 10 = 8 AS function_hit, CAST(CASE WHEN id % 10 = 8 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS ratio FROM $sqltext""",
)
def score_semantics(spark, sf):
    # Every item asks for the same function; the overloads come from the parts.
    items = spark_sql(
        spark,
        sf,
        "SELECT o_orderkey AS new_id, o_orderkey AS ord, named_struct('function_name', 'ST_Buffer', 'function', o_orderstatus) AS metadata FROM @orders",
    )
    sigs = spark_sql(
        spark,
        sf,
        "SELECT CASE WHEN p_size % 2 = 0 THEN 'st_buffer' ELSE p_type END AS function_name, array('geometry', 'integer') AS input_types, false AS variadic, p_partkey AS sig_ord FROM @part",
    )
    preds = from_view(spark, sf, "sqltext")
    scored = P.score_semantics(preds, items, sigs, ["id"])
    return scored.select(
        "id", "structure_valid", "function_hit", F.col("param_type_match_ratio").alias("ratio")
    )


@query(
    "score_references",
    "O53 O88 O89 O90 O91 O92 O93 O95 O107 O108",
    """SELECT model, count(*) AS matched_items, CAST(sum(th) AS BIGINT) AS table_hit_count, count(*) AS table_total_count, CAST(sum(ch) AS BIGINT) AS column_hit_count, CAST(2 * count(*) AS BIGINT) AS column_total_count FROM (
  SELECT model, CASE WHEN id % 10 IN (0, 6, 8, 9) THEN 1 ELSE 0 END AS th, CASE WHEN id % 10 IN (0, 6) THEN 1 WHEN id % 10 IN (8, 9) THEN 1 ELSE 0 END AS ch
  FROM $sqltext WHERE id IN (SELECT new_id FROM $items WHERE schema <> '') AND id % 10 NOT IN (4, 7)) GROUP BY model""",
)
def score_references(spark, sf):
    gold = spark_sql(
        spark,
        sf,
        "SELECT o_orderkey AS id, array(named_struct('table', 'Customer', 'columns', array('c_name', '\"geom\"'))) AS tables FROM @orders",
    )
    preds = from_view(spark, sf, "sqltext").withColumn("ord", F.col("id"))
    return P.score_references(preds, from_view(spark, sf, "items"), gold).drop(
        "table_hit_rate", "column_hit_rate"
    )


UNIQUE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, unique_key ORDER BY ord) AS nth FROM $runs WHERE coalesce(unique_key, '') <> '') WHERE nth = 1)"
RATE = "round(coalesce(CAST({0} AS DOUBLE) / nullif({1}, 0), 0), 4)"
RIGHT, RAN = "count(*) FILTER (WHERE result_correct = 'correct')", "count(*) FILTER (WHERE executable)"
# Every row has one text column, which passes if the statement ran.
REPORT = {
    "execution": f"""SELECT model, count(*) AS total_sql, {RAN} AS executable_sql_count, {RIGHT} AS correct_sql_count, count(*) AS total_columns, CAST(0 AS BIGINT) AS geometry_columns,
  count(*) AS text_columns, CAST(0 AS BIGINT) AS st_astext_column_pass, CAST(0 AS BIGINT) AS st_equals_z_column_pass, {RAN} AS value_match_column_pass, {RATE.format(RIGHT, "count(*)")} AS correct_sql_ratio,
  {RATE.format(RAN, "count(*)")} AS executable_sql_ratio, CAST(0 AS DOUBLE) AS geometry_st_astext_pass_ratio, CAST(0 AS DOUBLE) AS geometry_st_equals_z_pass_ratio, {RATE.format(RAN, "count(*)")} AS text_value_match_pass_ratio
  FROM {UNIQUE} GROUP BY model""",
    "with_passn": PASSES.replace("$runs", UNIQUE),
    "resource": f"""SELECT model, count(*) AS sample_count, CAST(sum(tokens_used) AS BIGINT) AS total_tokens_used, round(CAST(sum(tokens_used) AS DOUBLE) / count(*), 3) AS average_tokens_per_sample,
  round(sum(duration), 3) AS total_duration_sec FROM {UNIQUE} GROUP BY model""",
}
SHOWN = {
    "execution": ["total_sql", "executable_sql_count", "correct_sql_count", "total_columns", "geometry_columns", "text_columns", "st_astext_column_pass",
                  "st_equals_z_column_pass", "value_match_column_pass", "correct_sql_ratio", "executable_sql_ratio", "geometry_st_astext_pass_ratio",
                  "geometry_st_equals_z_pass_ratio", "text_value_match_pass_ratio"],
    "with_passn": ["num_samples", "pass_1_count", "pass_3_count", "pass_5_count", "pass@1", "pass@3", "pass@5"],
    "resource": ["sample_count", "total_tokens_used", "average_tokens_per_sample", "total_duration_sec"],
}
REPORT_COLUMNS = [(part, c) for part, names in SHOWN.items() for c in names]


@query(
    "model_report",
    "O46 O60 O102 O104 O105",
    "SELECT execution.model AS model, " + ", ".join(f'{p}."{c}" AS "{p}.{c}"' for p, c in REPORT_COLUMNS)
    + f" FROM ({REPORT['execution']}) execution JOIN ({REPORT['with_passn']}) with_passn ON execution.model = with_passn.model"
    + f" JOIN ({REPORT['resource']}) resource ON execution.model = resource.model",
)
def model_report(spark, sf):
    from ..operators.order import dedup_first

    runs = dedup_first(from_view(spark, sf, "runs")).withColumns(
        {
            "column_type": F.expr("array('text')"),
            "result_comparison": F.expr(
                "array(named_struct('column_pass_by_st_astext', false, 'column_pass_by_st_equals', false, "
                "'column_pass_by_st_z', false, 'column_pass_by_value_match', executable))"
            ),
        }
    )
    return P.model_report(runs).select("model", *[F.col(f"`{p}.{c}`") for p, c in REPORT_COLUMNS])


def sql_stub(prompt: str) -> tuple[str, int]:
    """Stands for a model that writes a fenced statement."""
    return f"```sql\nSELECT {len(prompt)}\n```", 1


@query(
    "generate_runs",
    "O14 O15 O19 O23 O26 O28 O13",
    f"""SELECT model, id, CAST(r AS BIGINT) AS round, md5(id || '__' || function || '__' || question || '__' || r) AS unique_key,
  'SELECT ' || length(trim({text_sql(PR.SQL_PROMPT, question="question")}, {WS})) AS pred_sql
FROM (SELECT c_custkey AS id, c_mktsegment AS function, c_name AS question FROM @customer), (VALUES ('m_A'), ('m_B')) m(model), range(1, 3) t(r)""",
)
def generate_runs(spark, sf):
    items = spark_sql(spark, sf, "SELECT c_custkey AS id, c_mktsegment AS function, c_name AS question FROM @customer")
    store, models = shared_dir(spark, "generated"), {"m_A": sql_stub, "m_B": sql_stub}
    # A first run gets one round done; the second finds it in the store and adds the other.
    P.generate_runs(items, models, 1, store)
    schema = "model STRING, id BIGINT, round BIGINT, unique_key STRING, pred_sql STRING"
    done = spark.read.schema(schema).json(store)
    P.generate_runs(items, models, 2, store, done)
    return spark.read.schema(schema).json(store)


@query("analyse_errors", "O20 O96 O97 O109 O110", f'SELECT category, name, error_type, n AS "count" FROM ({NAMED})')
def analyse_errors(spark, sf):
    rows = from_view(spark, sf, "errors").select("model", "id", "execution_error")
    store = shared_dir(spark, "labelled")
    P.label_errors(rows.where("id % 3 = 0"), store, key=("model", "id"))
    done = spark.read.schema("model STRING, id BIGINT, execution_error STRING, error_type STRING").json(store)
    P.label_errors(rows, store, done, key=("model", "id"))
    reports = P.error_reports(spark.read.schema(done.schema).json(store), from_view(spark, sf, "model_names"))
    return reports["long"]
