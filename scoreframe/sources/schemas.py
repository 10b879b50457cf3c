"""Record schemas as DDL. Ids may be numbers or text in the files, so they are text."""

COLUMN_COMPARISON = (
    "ST_AsText_pass INT, ST_Equals_pass INT, ST_Z_pass INT, value_match_pass INT, "
    "total_rows INT, column_pass_by_st_astext BOOLEAN, column_pass_by_st_equals BOOLEAN, "
    "column_pass_by_st_z BOOLEAN, column_pass_by_value_match BOOLEAN, column_type STRING, "
    "pred_col STRING, gold_col STRING"
)

_CALL = (
    "model STRING, round INT, error STRING, tokens_used BIGINT, timestamp DOUBLE, "
    "start_time DOUBLE, duration DOUBLE, thread_id BIGINT, unique_key STRING"
)

SCHEMAS = {
    "mcq_items": (
        "new_id STRING, id STRING, function STRING, type STRING, question STRING, "
        "options MAP<STRING,STRING>, answer STRING"
    ),
    "tf_items": (
        "new_id STRING, id STRING, function STRING, type STRING, question STRING, answer STRING"
    ),
    "syntax_items": (
        "id STRING, function STRING, question STRING, sql STRING, execution_result VARIANT"
    ),
    "schema_items": (
        "new_id STRING, id STRING, db_id STRING, question_en STRING, question STRING, "
        "schema STRING, query STRING, "
        "metadata STRUCT<function_ids: STRING, function_name: STRING, function: STRING>"
    ),
    "signatures": "function_name STRING, input_types ARRAY<STRING>, variadic STRING",
    "sql_predictions": (
        "id STRING, function STRING, question STRING, gold_sql STRING, "
        f"expected_result VARIANT, pred_sql STRING, {_CALL}"
    ),
    "answer_predictions": (
        "new_id STRING, id STRING, function STRING, type STRING, question STRING, "
        f"gold_answer STRING, pred_answer STRING, {_CALL}"
    ),
    "execution_results": (
        "id STRING, function STRING, question STRING, gold_sql STRING, pred_sql STRING, "
        f"db_id STRING, {_CALL}, executable BOOLEAN, execution_error STRING, "
        "execution_time DOUBLE, result_correct STRING, column_type ARRAY<STRING>, "
        f"result_comparison ARRAY<STRUCT<{COLUMN_COMPARISON}>>, "
        "strategy_pass_rate STRUCT<st_astext: DOUBLE, st_equals: DOUBLE, st_z: DOUBLE, "
        "value_match: DOUBLE>, gold_executable BOOLEAN, gold_execution_time DOUBLE, "
        "gold_error STRING, pred_error STRING"
    ),
    "picked_refs": (
        "new_id STRING, id STRING, db_id STRING, "
        "tables ARRAY<STRUCT<table: STRING, columns: ARRAY<STRING>>>, error STRING"
    ),
}
