"""Function calls and argument types."""

from pyspark.sql import functions as F

from ..operators import calls as K
from ..session import spread
from .registry import from_view, query, spark_sql

# Calls with known arguments: nested calls, quoted commas and parentheses, casts.
CALLS = """SELECT o_orderkey AS id, o_custkey AS k, concat('m_', o_orderstatus) AS model,
  CASE o_orderkey % 4
    WHEN 0 THEN concat('SELECT ST_DWithin(ST_GeomFromText(', chr(39), 'POINT(1 2), (', chr(39), ', 4326), g.geom, ', CAST(o_custkey AS STRING), ') FROM t WHERE st_dwithin(1)')
    WHEN 1 THEN concat('SELECT st_dwithin ( ', CAST(o_totalprice AS STRING), '::numeric(12,2), CAST(k AS int), true, ', chr(39), 'it', chr(39), chr(39), 's, (x', chr(39), ' )')
    WHEN 2 THEN 'SELECT ST_DWithin(a.b, (1 + 2), -3'
    ELSE concat('SELECT ST_Area(ST_DWithin(', CAST(o_custkey AS STRING), ', ''x''))') END AS pred_sql
FROM @orders""".replace("''x''", "', chr(39), 'x', chr(39), '")

ARGS = """SELECT id, k, c AS call_idx, args, types FROM (
  SELECT id, k, 0 AS c, 'ST_GeomFromText(''POINT(1 2), ('', 4326)|g.geom|' || k AS args, 'geometry|ERROR|integer' AS types FROM calls WHERE id % 4 = 0
  UNION ALL SELECT id, k, 1, '1', 'integer' FROM calls WHERE id % 4 = 0
  UNION ALL SELECT id, k, 0, pred_sql[21:strpos(pred_sql, '::') - 1] || '::numeric(12,2)|CAST(k AS int)|true|''it''''s, (x''', 'numeric|integer|boolean|unknown' FROM calls WHERE id % 4 = 1
  UNION ALL SELECT id, k, 0, k || '|''x''', 'integer|unknown' FROM calls WHERE id % 4 = 3)"""
WITH_CALLS = "WITH calls AS (" + CALLS + ") "


def _calls(spark, sf):
    return spark_sql(spark, sf, CALLS).withColumn("function_name_used", F.lit("ST_DWithin"))


@query("calls", "O81", f"{WITH_CALLS} SELECT id, 'st_dwithin' AS fn, call_idx, args FROM ({ARGS})")
def calls(spark, sf):
    found = K.calls(_calls(spark, sf), ["id"], "function_name_used")
    return found.withColumn("args", F.array_join("args", "|"))


@query(
    "structure_valid",
    "O82",
    """SELECT id, id % 10 IN (1, 8, 9) AS valid FROM $sqltext""",
)
def structure_valid(spark, sf):
    rows = from_view(spark, sf, "sqltext")
    return K.with_calls(rows).select("id", F.col("structure_valid").alias("valid"))


@query("arg_types", "O83", f"{WITH_CALLS} SELECT c.id, a.types FROM calls c LEFT JOIN ({ARGS}) a ON c.id = a.id AND a.call_idx = 0")
def arg_types(spark, sf):
    returns = spark_sql(
        spark,
        sf,
        "SELECT DISTINCT CASE WHEN p_size > 10 THEN 'ST_GeomFromText' ELSE p_type END AS function_name, "
        "CASE WHEN p_size > 10 THEN 'geometry' ELSE 'text' END AS return_type FROM @part",
    )
    typed = K.arg_types(K.first_call(_calls(spark, sf)), ["id"], returns)
    short = F.transform("actual_arg_types", lambda t: F.substring_index(t, ":", 1))
    return typed.select("id", F.array_join(short, "|").alias("types"))


# Expressions around the numbers, dates and texts of an order; the last kind names a column.
EXPRESSIONS = """SELECT o_orderkey AS id, CASE o_orderkey % 9
    WHEN 0 THEN concat(CAST(o_custkey AS STRING), ' + ', CAST(o_totalprice AS STRING), ' * 2')
    WHEN 1 THEN concat(chr(39), o_orderstatus, ' (', chr(39), ' || ', CAST(o_custkey AS STRING), '::text')
    WHEN 2 THEN concat('ST_Buffer(ST_GeomFromText(', chr(39), 'POINT(1 2)', chr(39), ', 4326), (', CAST(o_custkey AS STRING), ' + 1) * 2)')
    WHEN 3 THEN concat('(', CAST(o_custkey AS STRING), ' / 2) < ', CAST(o_totalprice AS STRING), ' OR g.geom IS NULL')
    WHEN 4 THEN concat('CASE WHEN ', CAST(o_custkey AS STRING), ' > 5 THEN 3000000000 ELSE ', CAST(o_custkey AS STRING), ' END')
    WHEN 5 THEN concat('DATE ', chr(39), '1995-01-01', chr(39), ' - CAST(', chr(39), '1994-01-01', chr(39), ' AS date)')
    WHEN 6 THEN concat('ARRAY[', CAST(o_custkey AS STRING), ', ', CAST(o_totalprice AS STRING), ']')
    WHEN 7 THEN concat('area(', CAST(o_custkey AS STRING), ')::numeric(10,2) + 1.5::float8')
    ELSE concat('g.geom + ', CAST(o_custkey AS STRING)) END AS expr
FROM @orders"""


@query(
    "expression_types",
    "O83",
    """SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN 'numeric' WHEN 1 THEN 'text' WHEN 2 THEN 'geometry' WHEN 4 THEN 'bigint'
  WHEN 5 THEN 'integer' WHEN 6 THEN 'numeric[]' WHEN 7 THEN 'double precision' ELSE 'ERROR' END AS kind FROM @orders""",
)
def expression_types(spark, sf):
    returns = spark_sql(
        spark, sf, "SELECT DISTINCT concat('ST_', CASE WHEN p_size > 10 THEN 'GeomFromText' ELSE 'Buffer' END) AS function_name, 'geometry' AS return_type FROM @part"
    )
    rows = spread(spark_sql(spark, sf, EXPRESSIONS), "id").withColumn("args", F.array("expr"))
    typed = K.arg_types(rows, ["id"], returns)
    return typed.select("id", F.substring_index(F.col("actual_arg_types")[0], ":", 1).alias("kind"))


def _typed(spark, sf):
    return from_view(spark, sf, "typed_calls").withColumn("actual_arg_types", F.split("types", ","))


def _sigs(spark, sf):
    return from_view(spark, sf, "signatures").withColumn("input_types", F.split("types", ","))


CANDIDATES = """SELECT c.id, c.model, s.sig_ord, s.variadic AS vari, string_split(c.types, ',') AS a, string_split(s.types, ',') AS e
FROM $typed_calls c JOIN $signatures s ON lower(c.function_name) = lower(s.function_name)
WHERE CASE WHEN s.variadic THEN len(string_split(c.types, ',')) >= len(string_split(s.types, ',')) ELSE len(string_split(c.types, ',')) = len(string_split(s.types, ',')) END"""
# Per position; a variadic list repeats its last type.
POSITIONS = f"""SELECT id, model, sig_ord, vari, e, len(a) AS n, i, a[i] AS act, e[least(i, len(e))] AS ex FROM ({CANDIDATES}), range(1, 4) t(i) WHERE i <= len(a)"""
SCORED = f"""SELECT id, model, sig_ord, vari, e, n, count(*) FILTER (WHERE act = ex) AS hits,
  string_agg(CASE WHEN act = ex THEN '✔ ' || act ELSE '✘ ' || act || ' ≠ ' || ex END, ';' ORDER BY i) AS detail FROM ({POSITIONS}) GROUP BY ALL"""


@query("join_signatures", "O55", f"SELECT id, sig_ord FROM ({CANDIDATES})")
def join_signatures(spark, sf):
    return K.join_signatures(_typed(spark, sf), _sigs(spark, sf)).select("id", "sig_ord")


@query("type_match", "O84", f"SELECT id, sig_ord, CAST(hits AS INTEGER) AS hits, round(CAST(hits AS DOUBLE) / n, 4) AS ratio FROM ({SCORED}) WHERE NOT vari")
def type_match(spark, sf):
    pairs = K.join_signatures(_typed(spark, sf), _sigs(spark, sf).where("NOT variadic"))
    actual, expected = F.col("actual_arg_types"), F.col("expected_types")
    return pairs.select(
        "id",
        "sig_ord",
        K.type_match(actual, expected).alias("hits"),
        F.round(K.match_ratio(actual, expected, F.col("variadic")), 4).alias("ratio"),
    )


@query("type_match_variadic", "O85", f"SELECT id, sig_ord, round(CAST(hits AS DOUBLE) / n, 4) AS ratio FROM ({SCORED}) WHERE vari")
def type_match_variadic(spark, sf):
    pairs = K.join_signatures(_typed(spark, sf), _sigs(spark, sf).where("variadic"))
    ratio = K.match_ratio(F.col("actual_arg_types"), F.col("expected_types"), F.col("variadic"))
    return pairs.select("id", "sig_ord", F.round(ratio, 4).alias("ratio"))


@query("match_detail", "O86", f"SELECT id, sig_ord, detail FROM ({SCORED})")
def match_detail(spark, sf):
    pairs = K.join_signatures(_typed(spark, sf), _sigs(spark, sf))
    detail = K.match_detail(F.col("actual_arg_types"), F.col("expected_types"), F.col("variadic"))
    return pairs.select("id", "sig_ord", F.array_join(detail, ";").alias("detail"))


BEST = f"""SELECT c.id, c.model, coalesce(b.ratio, 0) AS ratio, coalesce(b.e, '') AS expected, coalesce(b.detail, '') AS detail FROM $typed_calls c LEFT JOIN (
  SELECT id, round(CAST(hits AS DOUBLE) / n, 4) AS ratio, array_to_string(e, ',') AS e, detail FROM ({SCORED}) WHERE hits > 0
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY CAST(hits AS DOUBLE) / n DESC, sig_ord) = 1) b ON c.id = b.id"""


def _best(spark, sf):
    return K.best_signature(_typed(spark, sf), _sigs(spark, sf), ["id"])


@query("best_signature", "O87", f"SELECT id, ratio, expected, detail FROM ({BEST})")
def best_signature(spark, sf):
    return _best(spark, sf).select(
        "id",
        F.col("param_type_match_ratio").alias("ratio"),
        F.array_join("expected_arg_types", ",").alias("expected"),
        F.array_join("param_type_match_detail", ";").alias("detail"),
    )


@query(
    "semantic_summary",
    "O106",
    f"""SELECT model, count(*) AS total, count(*) FILTER (WHERE id % 9 <> 0) AS structure_valid_count, count(*) FILTER (WHERE id % 9 > 1) AS function_hit_count,
  round(CAST(count(*) FILTER (WHERE id % 9 <> 0) AS DOUBLE) / count(*), 4) AS structure_valid_ratio, round(CAST(count(*) FILTER (WHERE id % 9 > 1) AS DOUBLE) / count(*), 4) AS function_hit_ratio,
  round(avg(ratio) FILTER (WHERE NOT (id % 9 > 1 AND ratio = 0)), 4) AS avg_param_type_match_ratio, round(avg(ratio), 4) AS avg_ratio_all
FROM (SELECT id, model, CASE WHEN id % 9 > 1 THEN ratio ELSE 0 END AS ratio FROM ({BEST})) GROUP BY model""",
)
def semantic_summary(spark, sf):
    from ..operators import metrics as M

    scored = _best(spark, sf).withColumns(
        {
            "structure_valid": F.col("id") % 9 != 0,
            "function_hit": F.col("id") % 9 > 1,
            "param_type_match_ratio": F.when(
                F.col("id") % 9 > 1, F.col("param_type_match_ratio")
            ).otherwise(0.0),
        }
    )
    return M.semantic_summary(scored)
