"""Order, first and last rows, sets."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sqltext as S
from ..operators import cells as C
from ..operators import order as R
from .registry import from_view, query, spark_sql


@query(
    "ingest_order",
    "O8",
    """SELECT model, id, round, row_number() OVER (PARTITION BY model, id ORDER BY ord) AS position FROM $runs""",
)
def ingest_order(spark, sf):
    runs = from_view(spark, sf, "runs")
    return R.running_index(runs, ["model", "id"], ["ord"], "position").select(
        "model", "id", "round", "position"
    )


@query(
    "is_sorted",
    "O44",
    """SELECT model, id, function, bool_and(ok) AS is_sorted FROM (
  SELECT model, id, function, round >= coalesce(lag(round) OVER (PARTITION BY model, id, function ORDER BY ord), round) AS ok
  FROM $runs) GROUP BY model, id, function""",
)
def is_sorted(spark, sf):
    runs = from_view(spark, sf, "runs")
    return R.is_sorted_within(runs, ["model", "id", "function"])


@query(
    "reorder_runs",
    "O45",
    """SELECT *, CAST(row_number() OVER (PARTITION BY model, id, function ORDER BY round, ord) AS INTEGER) AS place FROM (
  SELECT model, id, function, round, ord FROM $runs)""",
)
def reorder_runs(spark, sf):
    runs = from_view(spark, sf, "runs").select("model", "id", "function", "round", "ord")
    ordered = R.reorder_runs(runs, ("model", "id", "function"))
    # The places come from where the rows are in the sorted output, not from their columns.
    at = ordered.withColumn("_at", F.monotonically_increasing_id())
    w = Window.partitionBy("model", "id", "function").orderBy("_at")
    return at.withColumn("place", F.row_number().over(w)).drop("_at")


@query(
    "dedup_first",
    "O46",
    """SELECT model, id, round, unique_key, ord, result_correct FROM (
  SELECT *, row_number() OVER (PARTITION BY model, unique_key ORDER BY ord) AS rn FROM $runs WHERE coalesce(unique_key, '') <> '')
WHERE rn = 1""",
)
def dedup_first(spark, sf):
    runs = from_view(spark, sf, "runs").select(
        "model", "id", "round", "unique_key", "ord", "result_correct"
    )
    return R.dedup_first(runs)


@query(
    "last_per_key",
    "O47",
    """SELECT new_id, max(ord) AS ord, arg_max(coalesce(db_id, 'none'), ord) AS db_id FROM $items GROUP BY new_id""",
)
def last_per_key(spark, sf):
    items = from_view(spark, sf, "items").select(
        "new_id", "ord", F.coalesce("db_id", F.lit("none")).alias("db_id")
    )
    return R.last_per_key(items, ["new_id"])


@query(
    "dedup_columns",
    "O48",
    """SELECT query_id, side, col_idx, CASE WHEN rn = 0 THEN col_name ELSE col_name || '_' || rn END AS col_name FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, side, col_name ORDER BY col_idx) - 1 AS rn FROM (
    SELECT l_orderkey AS query_id, l_returnflag AS side, l_linenumber * 100000000 + l_partkey AS col_idx, 'c' || (l_partkey % 3) AS col_name FROM @lineitem))""",
)
def dedup_columns(spark, sf):
    cols = spark_sql(
        spark,
        sf,
        """SELECT l_orderkey AS query_id, l_returnflag AS side, l_linenumber * 100000000 + l_partkey AS col_idx,
  concat('c', CAST(l_partkey % 3 AS STRING)) AS col_name FROM @lineitem""",
    )
    return R.dedup_columns(cols)


@query(
    "distinct_rows",
    "O49",
    """SELECT id AS query_id, min(ord) AS row_idx, model AS v0, function AS v1 FROM $runs GROUP BY id, model, function""",
)
def distinct_rows(spark, sf):
    rows = from_view(spark, sf, "runs").select(
        F.col("id").alias("query_id"), F.col("ord").alias("row_idx"), F.array("model", "function").alias("r")
    )
    cells = rows.select(
        "query_id", F.lit("pred").alias("side"), "row_idx", F.posexplode("r").alias("col_idx", "value")
    )
    value = lambda i: F.max(F.when(F.col("col_idx") == i, F.col("value")))
    return (
        C.distinct_rows(cells)
        .groupBy("query_id", "row_idx")
        .agg(value(0).alias("v0"), value(1).alias("v1"))
    )


@query(
    "overlap",
    "O50",
    """SELECT doc_id, CAST(len(list_intersect(list_distinct(string_split(text, ' ')), list_distinct(string_split(source || ' ' || lang || ' the la', ' ')))) AS INTEGER) AS shared
FROM @documents""",
)
def overlap(spark, sf):
    docs = spark_sql(spark, sf, "SELECT doc_id, text, source, lang FROM @documents")
    return docs.select(
        "doc_id",
        S.overlap(
            F.split("text", " "),
            F.split(F.concat_ws(" ", "source", "lang", F.lit("the la")), " "),
        ).alias("shared"),
    )


@query(
    "union_refs",
    "O51",
    """SELECT o_orderkey, array_to_string(list_filter([a, b, c, d], lambda x, i: list_position([a, b, c, d], x) = i), ',') AS refs
FROM (SELECT o_orderkey, 't' || (o_custkey % 3) AS a, 't' || (o_custkey % 5) AS b, 't' || (o_orderkey % 4) AS c, 't' || (o_custkey % 2) AS d FROM @orders)""",
)
def union_refs(spark, sf):
    refs = spark_sql(
        spark,
        sf,
        """SELECT o_orderkey, array(concat('t', o_custkey % 3), concat('t', o_custkey % 5)) AS x,
  array(concat('t', o_orderkey % 4), concat('t', o_custkey % 2)) AS y FROM @orders""",
    )
    return refs.select(
        "o_orderkey", F.array_join(S.union_refs(F.col("x"), F.col("y")), ",").alias("refs")
    )
