"""Error classes and reports."""

from pyspark.sql import functions as F

from ..operators import errors as X
from .registry import from_view, query

CLASS = """CASE WHEN trim(execution_error) = '' THEN NULL WHEN lower(execution_error) LIKE '%mixed srid%' THEN 'SRID/Dimension Mismatch' WHEN execution_error LIKE 'parse error%' THEN 'Geometry Parsing Errors'
  WHEN execution_error LIKE 'Row count mismatch%' THEN 'Result Mismatch Errors' WHEN execution_error LIKE 'function %' THEN 'PostGIS Function Errors' WHEN execution_error LIKE 'relation %' THEN 'Missing Objects'
  WHEN execution_error LIKE '%syntax error%' THEN 'SQL Syntax Errors' ELSE 'Environment/Connection Errors' END"""
LABEL = """CASE id % 4 WHEN 0 THEN 'SQL Syntax Errors' WHEN 2 THEN 'PostGIS Function Errors' ELSE 'Environment/Connection Errors' END"""
COUNTS = f"""SELECT model, {CLASS} AS error_type, count(*) AS n FROM $errors WHERE trim(execution_error) <> '' GROUP BY 1, 2"""
NAMED = f"SELECT m.category, m.name, c.error_type, c.n FROM ({COUNTS}) c JOIN $model_names m ON c.model = m.model"


def _errors(spark, sf):
    return from_view(spark, sf, "errors")


def _counts(spark, sf):
    return X.error_counts(X.classify_errors(_errors(spark, sf)))


def _names(spark, sf):
    return from_view(spark, sf, "model_names")


@query("classify_errors", "O96", f"SELECT id, {CLASS} AS error_type FROM $errors")
def classify_errors(spark, sf):
    return X.classify_errors(_errors(spark, sf)).select("id", "error_type")


@query(
    "classify_by_response",
    "O96 O97",
    f"SELECT id, CASE WHEN trim(execution_error) <> '' THEN {LABEL} END AS error_type FROM $errors",
)
def classify_by_response(spark, sf):
    return X.classify_errors(_errors(spark, sf), response="response").select("id", "error_type")


@query("whitelist_label", "O97", "SELECT id, CASE WHEN id % 4 = 2 THEN 'PostGIS Function Errors' ELSE 'Environment/Connection Errors' END AS label FROM $errors")
def whitelist_label(spark, sf):
    return _errors(spark, sf).select("id", X.whitelist_label("response").alias("label"))


@query(
    "error_prefix_counts",
    "O98",
    """SELECT model, split_part(execution_error, ':', 1) AS prefix, count(*) AS n FROM (
  SELECT model, trim(execution_error) AS execution_error FROM $errors WHERE execution_error <> '') GROUP BY 1, 2""",
)
def error_prefix_counts(spark, sf):
    return X.error_prefix_counts(_errors(spark, sf), "execution_error")


@query("error_counts", "O109", f'SELECT model, error_type, n AS "count" FROM ({COUNTS})')
def error_counts(spark, sf):
    return _counts(spark, sf)


@query("error_long", "O110", f'SELECT category, name, error_type, n AS "count" FROM ({NAMED})')
def error_long(spark, sf):
    return X.error_long(_counts(spark, sf), _names(spark, sf))


@query(
    "error_pivot",
    "O111",
    "SELECT error_type, " + ", ".join(
        f"CAST(coalesce(sum(n) FILTER (WHERE name = 'Model {i}'), 0) AS BIGINT) AS \"Model {i}\"" for i in (0, 2, 3)
    ) + f" FROM ({NAMED}) GROUP BY error_type",
)
def error_pivot(spark, sf):
    return X.error_pivot(_counts(spark, sf), _names(spark, sf), heads=[f"Model {i}" for i in (0, 2, 3)])


@query(
    "error_pivot_by_model",
    "O112",
    "SELECT m.category, m.name, " + ", ".join(
        f"CAST(coalesce(sum(n) FILTER (WHERE error_type = '{t}'), 0) AS BIGINT) AS \"{t}\"" for t in sorted(X.ERROR_TYPES)
    ) + f" FROM $model_names m LEFT JOIN ({COUNTS}) c ON c.model = m.model GROUP BY 1, 2",
)
def error_pivot_by_model(spark, sf):
    return X.error_pivot(_counts(spark, sf), _names(spark, sf), rows="model")
