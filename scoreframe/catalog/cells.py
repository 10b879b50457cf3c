"""Comparison of result tables."""

from pyspark.sql import functions as F

from ..functions.geometry import text_equal as same_text
from ..functions.sqltext import order_spec as spec
from ..operators import cells as C
from ..operators.pairs import run_pairs as run
from ..session import materialize, spread
from .registry import from_view, query, spark_sql


def _cells(spark, sf):
    return from_view(spark, sf, "cells")


def _placed(spark, sf):
    return from_view(spark, sf, "placed")


@query(
    "to_cells",
    "O61",
    """SELECT q, row_idx, col_idx, value FROM (
  SELECT id AS q, 0 AS row_idx, 0 AS col_idx, model AS value FROM $runs WHERE round = 1
  UNION ALL SELECT id, 0, 0, model FROM $runs WHERE round = 2
  UNION ALL SELECT id, 0, 1, CAST(tokens_used AS VARCHAR) FROM $runs WHERE round = 2
  UNION ALL SELECT id, 1, 0, function FROM $runs WHERE round = 2
  UNION ALL SELECT id, 0, 0, model FROM $runs WHERE round = 3
  UNION ALL SELECT id, 0, 1, '' FROM $runs WHERE round = 3
  UNION ALL SELECT id, 1, 0, '' FROM $runs WHERE round = 3
  UNION ALL SELECT id, 1, 1, CAST(tokens_used AS VARCHAR) FROM $runs WHERE round = 3
  UNION ALL SELECT id, 0, 0, model FROM $runs WHERE round = 4
  UNION ALL SELECT id, 0, 1, '' FROM $runs WHERE round = 4
  UNION ALL SELECT id, r, c, '' FROM $runs, (SELECT unnest([0, 1]) AS r), (SELECT unnest([0, 1]) AS c) WHERE round > 4)""",
)
def to_cells(spark, sf):
    text = """CASE round WHEN 1 THEN to_json(parse_json(concat('"  ', model, ' "')))
  WHEN 2 THEN concat('[["', model, '", ', tokens_used, '], ["', function, '"]]')
  WHEN 3 THEN concat('[{{"a": "', model, '"}}, {{"b": ', tokens_used, ', "z": 1}}]')
  WHEN 4 THEN concat('{{"a": "', model, '"}}') WHEN 5 THEN 'null' WHEN 6 THEN '17' ELSE '[1, [2]]' END""".replace(
        "{{", "{"
    ).replace("}}", "}")
    rows = from_view(spark, sf, "runs").select(
        F.col("id").alias("q"), F.parse_json(F.expr(text)).alias("v"), F.expr("array('a', 'b')").alias("names")
    )
    matrix = rows.withColumn("m", C.expected_rows(F.col("v"), F.col("names"), F.lit(2)))
    return C.to_cells(matrix, "m", "names", keys=("q",)).select("q", "row_idx", "col_idx", "value")


COUNTS = """SELECT query_id, count(*) FILTER (WHERE side = 'pred' AND col_idx = 0) AS p,
  count(*) FILTER (WHERE side = 'gold' AND col_idx = 0) AS g FROM $cells GROUP BY query_id"""


@query(
    "empty_rule",
    "O64",
    f"""SELECT query_id, CASE WHEN p = 0 THEN 'unknown' END AS syntax_level, CASE WHEN (p = 0 AND g = 0) OR query_id LIKE '%3' THEN 'unknown' END AS table_level
FROM ({COUNTS})""",
)
def empty_rule(spark, sf):
    p, g = F.col("pred_rows"), F.col("gold_rows")
    return C.row_counts(_cells(spark, sf)).select(
        "query_id",
        C.empty_rule(p, g, table_level=False).alias("syntax_level"),
        C.empty_rule(p, g, ~F.col("query_id").like("%3")).alias("table_level"),
    )


@query(
    "row_count_gate",
    "O65",
    f"""SELECT query_id, p AS pred_rows, g AS gold_rows, CASE WHEN p <> g THEN 'incorrect' END AS result_correct,
  CASE WHEN p <> g THEN 'Row count mismatch: pred ' || p || ' vs gold ' || g ELSE '' END AS execution_error FROM ({COUNTS})""",
)
def row_count_gate(spark, sf):
    return C.row_count_gate(C.row_counts(_cells(spark, sf)))


@query(
    "text_equal",
    "O72",
    """SELECT p.query_id, p.row_idx, p.col_idx AS pred_col, g.col_idx AS gold_col, coalesce(lower(trim(p.value)) = lower(trim(g.value)), p.value IS NULL AND g.value IS NULL) AS same
FROM $cells p JOIN $cells g ON p.query_id = g.query_id AND p.row_idx = g.row_idx AND p.side = 'pred' AND g.side = 'gold'""",
)
def text_equal(spark, sf):
    cells = _cells(spark, sf)
    pick = lambda s, c, n: cells.where(F.col("side") == s).select(
        "query_id", "row_idx", F.col("col_idx").alias(c), F.col("value").alias(n)
    )
    pairs = pick("pred", "pred_col", "p").join(pick("gold", "gold_col", "g"), ["query_id", "row_idx"])
    return pairs.select("query_id", "row_idx", "pred_col", "gold_col", same_text("p", "g").alias("same"))


# Cell by cell in place. Points have whole coordinates, one of them moved below the grid.
FLAGS = """SELECT p.query_id, p.row_idx, p.col_idx, g.value IS NOT NULL AND p.col_idx = 1 AS is_geom,
  g.value IS NOT NULL AND p.col_idx = 1 AND p.q % 4 < 2 AS as_text, g.value IS NOT NULL AND p.col_idx = 1 AS equals,
  g.value IS NOT NULL AND p.col_idx = 1 AND p.q % 4 <> 3 AS z,
  (g.value IS NULL OR p.col_idx = 0) AND lower(trim(p.value)) = lower(trim(coalesce(g.value, ''))) AS value_match
FROM (SELECT *, CAST(query_id[2:] AS BIGINT) AS q FROM $placed WHERE side = 'pred') p
LEFT JOIN (SELECT * FROM $placed WHERE side = 'gold') g ON p.query_id = g.query_id AND p.row_idx = g.row_idx AND p.col_idx = g.col_idx"""


@query("compare_positional", "O58", FLAGS)
def compare_positional(spark, sf):
    return C.compare_positional(_placed(spark, sf)).drop("pred", "gold")


STATS = f"""SELECT *, g AND a = n AS column_pass_by_st_astext, g AND e = n AS column_pass_by_st_equals, g AND z = n AS column_pass_by_st_z,
  NOT g AND v = n AS column_pass_by_value_match FROM (SELECT query_id, col_idx, count(*) FILTER (WHERE as_text) AS a, count(*) FILTER (WHERE equals) AS e,
  count(*) FILTER (WHERE z) AS z, count(*) FILTER (WHERE value_match) AS v, count(*) AS n, bool_or(is_geom) AS g FROM ({FLAGS}) GROUP BY query_id, col_idx)"""


def _stats(spark, sf):
    return C.column_stats(C.compare_positional(_placed(spark, sf)))


@query(
    "column_stats",
    "O75",
    f"""SELECT query_id, col_idx, a AS "ST_AsText_pass", e AS "ST_Equals_pass", z AS "ST_Z_pass", v AS value_match_pass, n AS total_rows,
  CASE WHEN g THEN 'geometry' ELSE 'text' END AS column_type, column_pass_by_st_astext, column_pass_by_st_equals, column_pass_by_st_z, column_pass_by_value_match FROM ({STATS})""",
)
def column_stats(spark, sf):
    return _stats(spark, sf)


@query(
    "column_type_last_row",
    "O73",
    f"SELECT query_id, col_idx, CASE WHEN arg_max(is_geom, row_idx) THEN 'geometry' ELSE 'text' END AS column_type FROM ({FLAGS}) GROUP BY query_id, col_idx",
)
def column_type_last_row(spark, sf):
    flags = C.compare_positional(_placed(spark, sf))
    return C.column_stats(flags, column_type="last_row").select("query_id", "col_idx", "column_type")


@query(
    "strategy_rates",
    "O77",
    f"""SELECT query_id, round(count(*) FILTER (WHERE column_pass_by_st_astext) / count(*), 4) AS st_astext, round(count(*) FILTER (WHERE column_pass_by_st_equals) / count(*), 4) AS st_equals,
  round(count(*) FILTER (WHERE column_pass_by_st_z) / count(*), 4) AS st_z, round(count(*) FILTER (WHERE column_pass_by_value_match) / count(*), 4) AS value_match
FROM ({STATS}) GROUP BY query_id""",
)
def strategy_rates(spark, sf):
    return C.strategy_rates(_stats(spark, sf))


@query(
    "verdict",
    "O78",
    f"""SELECT query_id, CASE WHEN bool_and(CASE WHEN g THEN column_pass_by_st_astext OR (column_pass_by_st_equals AND column_pass_by_st_z) ELSE column_pass_by_value_match END)
  THEN 'correct' ELSE 'incorrect' END AS result_correct FROM ({STATS}) GROUP BY query_id""",
)
def verdict(spark, sf):
    return C.verdict(_stats(spark, sf))


# Column against column, all cells of both.
EQUAL = """SELECT p.query_id, p.col_idx AS pc, g.col_idx AS gc FROM (SELECT * FROM $cells WHERE side = 'pred') p
JOIN (SELECT * FROM $cells WHERE side = 'gold') g ON p.query_id = g.query_id AND p.row_idx = g.row_idx
GROUP BY 1, 2, 3 HAVING bool_and(coalesce(lower(trim(p.value)) = lower(trim(g.value)), p.value IS NULL AND g.value IS NULL))
"""


@query(
    "compare_columns",
    "O57",
    f"""SELECT c.query_id, c.col_idx AS pred_col, coalesce(string_agg(CAST(e.gc AS VARCHAR), ',' ORDER BY e.gc), '') AS gold_cols
FROM (SELECT DISTINCT query_id, col_idx FROM $cells WHERE side = 'pred') c
JOIN (SELECT query_id FROM ({COUNTS}) WHERE p = g) k ON c.query_id = k.query_id
LEFT JOIN ({EQUAL}) e ON c.query_id = e.query_id AND c.col_idx = e.pc GROUP BY c.query_id, c.col_idx""",
)
def compare_columns(spark, sf):
    cells = _cells(spark, sf)
    passed = C.comparable(cells, C.row_count_gate(C.row_counts(cells)))
    return C.compare_columns(materialize(C.column_prints(passed), "prints")).withColumn(
        "gold_cols", F.array_join(F.col("gold_cols").cast("array<string>"), ",")
    )


@query(
    "match_columns",
    "O76",
    f"""SELECT e.query_id, e.pc AS pred_col, e.gc AS gold_col, 'text' AS column_type, k.p AS total_rows FROM ({EQUAL}) e JOIN ({COUNTS}) k ON e.query_id = k.query_id AND k.p = k.g""",
)
def match_columns(spark, sf):
    cells = _cells(spark, sf)
    passed = C.comparable(cells, C.row_count_gate(C.row_counts(cells)))
    return C.match_columns(passed).select(
        "query_id", "pred_col", "gold_col", "column_type", "total_rows"
    )


@query(
    "match_geometry_columns",
    "O76 O69 O70 O71",
    """SELECT 'q' || q AS query_id, CAST(c AS INTEGER) AS pred_col, CAST(c AS INTEGER) AS gold_col, CASE WHEN c = 1 THEN 'geometry' ELSE 'text' END AS column_type,
  CAST(CASE WHEN c = 1 AND q % 4 < 2 THEN n ELSE 0 END AS BIGINT) AS "ST_AsText_pass", CAST(CASE WHEN c = 1 THEN n ELSE 0 END AS BIGINT) AS "ST_Equals_pass"
FROM (SELECT q, count(*) AS n, max(CASE WHEN row_idx = 7 THEN 1 ELSE 0 END) AS has7 FROM $grid GROUP BY q), (SELECT unnest([0, 1]) AS c)
WHERE (c = 0 AND NOT (q % 3 = 1 AND has7 = 1)) OR (c = 1 AND q % 4 <> 3 AND q % 6 <> 5)""",
)
def match_geometry_columns(spark, sf):
    return C.match_columns(spread(_placed(spark, sf), "query_id", "row_idx")).select(
        "query_id", "pred_col", "gold_col", "column_type", "ST_AsText_pass", "ST_Equals_pass"
    )


@query(
    "subset_verdict",
    "O76 O78",
    f"""SELECT query_id, CASE WHEN u IS NULL THEN 'correct' ELSE 'incorrect' END AS result_correct,
  CASE WHEN u IS NULL THEN '' ELSE 'Column subset match failed, unmatched pred columns: ' || u END AS execution_error FROM (
  SELECT c.query_id, string_agg(CASE WHEN e.gc IS NULL THEN c.col_name END, ', ' ORDER BY c.col_name) AS u
  FROM (SELECT DISTINCT query_id, col_idx, col_name FROM $cells WHERE side = 'pred') c
  JOIN (SELECT query_id FROM ({COUNTS}) WHERE p = g) k ON c.query_id = k.query_id
  LEFT JOIN ({EQUAL}) e ON c.query_id = e.query_id AND c.col_idx = e.pc GROUP BY c.query_id)""",
)
def subset_verdict(spark, sf):
    cells = _cells(spark, sf)
    passed = C.comparable(cells, C.row_count_gate(C.row_counts(cells)))
    prints = materialize(C.column_prints(passed), "prints")
    return C.subset_verdict(prints, C.match_columns(passed, prints=prints))


@query(
    "geometry_columns",
    "O74",
    """SELECT query_id, side, col_idx, col_idx = 1 AS is_geom FROM $placed GROUP BY query_id, side, col_idx""",
)
def geometry_columns(spark, sf):
    return C.geometry_columns(_placed(spark, sf))


# Rows in any order: the prediction repeats one row and reverses the order.
UNORDERED = """SELECT query_id, side, row_idx, col_idx, col_name, value FROM $placed WHERE side = 'gold'
UNION ALL SELECT query_id, 'pred', 1000 - row_idx, 1 - col_idx, col_name, CASE WHEN row_idx = 7 AND query_id LIKE '%2' THEN 'x' ELSE upper(value) END FROM $placed WHERE side = 'gold'
UNION ALL SELECT query_id, 'pred', 2000, 1 - col_idx, col_name, upper(value) FROM $placed WHERE side = 'gold' AND row_idx = 3"""


@query(
    "multiset_compare",
    "O80",
    f"""SELECT query_id, NOT (query_id LIKE '%2' AND max(CASE WHEN row_idx = 7 THEN 1 ELSE 0 END) = 1) AS same_rows
FROM $placed WHERE side = 'gold' GROUP BY query_id""",
)
def multiset_compare(spark, sf):
    return C.multiset_compare(spark_sql(spark, sf, UNORDERED))


_CELL = """string_agg('{"c":"' || col_name || '","v":"' || coalesce(%s, '\\u0000') || '"}', ',' ORDER BY col_name)"""


@query(
    "normalize_table",
    "O80",
    f"""SELECT query_id, side, '[' || row || ']' AS row, count(*) AS times FROM (SELECT DISTINCT query_id, side, raw, row FROM (
  SELECT query_id, side, row_idx, {_CELL % "value"} AS raw, {_CELL % "lower(trim(value))"} AS row FROM $cells GROUP BY 1, 2, 3)) GROUP BY 1, 2, 3""",
)
def normalize_table(spark, sf):
    return C.normalize_table(_cells(spark, sf))


@query(
    "ordered_rows",
    "O79 O80",
    """SELECT query_id, side, row_idx, CAST(CASE WHEN q % 2 = 0 THEN row_number() OVER (PARTITION BY query_id, side ORDER BY nation DESC, name, row_idx)
  ELSE row_number() OVER (PARTITION BY query_id, side ORDER BY name DESC, row_idx) END AS INTEGER) AS place FROM (
  SELECT query_id, side, row_idx, CAST(substr(query_id, 2) AS BIGINT) AS q, max(value) FILTER (WHERE col_name = 'nation') AS nation, max(value) FILTER (WHERE col_name = 'name') AS name
  FROM $cells GROUP BY 1, 2, 3)""",
)
def ordered_rows(spark, sf):
    cells = _cells(spark, sf)
    text = F.when(F.substring("query_id", 2, 9).cast("bigint") % 2 == 0, "SELECT 1 ORDER BY nation DESC, name").otherwise(
        "SELECT 1 ORDER BY none, name DESC LIMIT 3"
    )
    specs = cells.select("query_id", "side").distinct().withColumn("sql", text).withColumn("spec", spec("sql"))
    return C.ordered_rows(cells, specs)


@query(
    "order_spec",
    "O79",
    """SELECT id, CASE WHEN id % 10 = 9 THEN 'p_name:false,p_partkey:true' ELSE '' END AS spec FROM $sqltext""",
)
def order_spec(spark, sf):
    shown = F.transform(
        spec("pred_sql"), lambda o: F.concat_ws(":", o["column"], o["ascending"].cast("string"))
    )
    return from_view(spark, sf, "sqltext").select("id", F.array_join(shown, ",").alias("spec"))


PAIRS = [
    (
        "by_segment",
        "SELECT c_mktsegment, count(*) AS n FROM {customer} GROUP BY c_mktsegment ORDER BY c_mktsegment;",
        "SELECT count(*) AS k, upper(c_mktsegment) AS s FROM {customer} GROUP BY 2 ORDER BY s",
    ),
    (
        "names",
        "SELECT c_custkey, c_name FROM {customer} ORDER BY c_custkey DESC",
        "SELECT c_custkey, c_name FROM {no_such_table} ORDER BY c_custkey DESC",
    ),
    (
        "names_again",
        "SELECT c_custkey, c_name FROM {customer} ORDER BY c_custkey DESC",
        "SELECT c_custkey, lower(c_name) AS c_name FROM {customer} ORDER BY c_custkey DESC",
    ),
]


@query(
    "run_pairs",
    "O62",
    """WITH g AS (SELECT c_mktsegment AS s, count(*) AS n, row_number() OVER (ORDER BY c_mktsegment) - 1 AS r FROM @customer GROUP BY 1),
c AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey DESC) - 1 AS r FROM @customer)
SELECT 'by_segment' AS query_id, 'gold' AS side, r AS row_idx, 0 AS col_idx, 'c_mktsegment' AS col_name, s AS value FROM g
UNION ALL SELECT 'by_segment', 'gold', r, 1, 'n', CAST(n AS VARCHAR) FROM g
UNION ALL SELECT 'by_segment', 'pred', r, 0, 'k', CAST(n AS VARCHAR) FROM g
UNION ALL SELECT 'by_segment', 'pred', r, 1, 's', upper(s) FROM g
UNION ALL SELECT q, 'gold', r, 0, 'c_custkey', CAST(c_custkey AS VARCHAR) FROM c, (SELECT unnest(['names', 'names_again']) AS q)
UNION ALL SELECT q, 'gold', r, 1, 'c_name', c_name FROM c, (SELECT unnest(['names', 'names_again']) AS q)
UNION ALL SELECT 'names_again', 'pred', r, 0, 'c_custkey', CAST(c_custkey AS VARCHAR) FROM c
UNION ALL SELECT 'names_again', 'pred', r, 1, 'c_name', lower(c_name) FROM c""",
)
def run_pairs(spark, sf):
    table = f"parquet.`{sf}/customer.parquet`"
    named = [
        (i, *(s.replace("{customer}", table).replace("{no_such_table}", "no_such_table") for s in pair))
        for i, *pair in PAIRS
    ]
    cells, _ = run(spark, named)
    return cells
