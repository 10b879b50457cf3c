"""Lookups and merges."""

from pyspark.sql import functions as F

from ..operators import enrich as E
from ..operators import metrics as M
from ..operators.report import merge_summaries as merge
from ..sources import only_models as only
from ..sources import report_table as table
from .registry import from_view, query, spark_sql

LAST_ITEM = """(SELECT new_id, arg_max({c}, ord) AS {c} FROM (SELECT new_id, ord, {e} AS {c} FROM $items) WHERE {w} GROUP BY new_id)"""


def _sqltext(spark, sf):
    return from_view(spark, sf, "sqltext")


@query(
    "attach_db",
    "O52",
    f"""SELECT s.id, nullif(i.db, '-') AS db_id FROM $sqltext s LEFT JOIN
  {LAST_ITEM.format(c='db', e="coalesce(db_id, '-')", w='true')} i ON s.id = i.new_id""",
)
def attach_db(spark, sf):
    return E.attach_db(_sqltext(spark, sf).select("id"), from_view(spark, sf, "items"))


@query(
    "attach_schema",
    "O53",
    f"""SELECT s.id, i.st AS schema, CASE WHEN i.st IS NULL THEN 'Missing schema_text for this id' END AS schema_error
FROM (SELECT id FROM $sqltext) s LEFT JOIN {LAST_ITEM.format(c='st', e='schema', w="st <> ''")} i ON s.id = i.new_id""",
)
def attach_schema(spark, sf):
    return E.attach_schema(_sqltext(spark, sf), from_view(spark, sf, "items")).select(
        "id", "schema", "schema_error"
    )


@query(
    "attach_function",
    "O54",
    f"""SELECT id, function_name_used, CASE WHEN function_name_used IS NULL THEN 'Missing function_name (id->new_id mapping or fallback failed)' END AS semantic_error FROM (
  SELECT s.id, coalesce(i.fn, CASE WHEN s.id % 3 = 0 THEN 'own_' || s.model END) AS function_name_used
  FROM $sqltext s LEFT JOIN {LAST_ITEM.format(c='fn', e="coalesce(nullif(function_name, ''), function_alt)", w='fn IS NOT NULL')} i ON s.id = i.new_id)""",
)
def attach_function(spark, sf):
    items = from_view(spark, sf, "items").withColumn(
        "metadata", F.struct("function_name", F.col("function_alt").alias("function"))
    )
    own = F.when(F.col("id") % 3 == 0, F.concat(F.lit("own_"), "model"))
    preds = _sqltext(spark, sf).withColumn("function", own)
    return E.attach_function(preds, items).select("id", "function_name_used", "semantic_error")


@query(
    "join_gold",
    "O56",
    """SELECT r.model, r.id, r.round, r.ord, o.o_orderstatus AS gold FROM $runs r JOIN @orders o ON r.id = o.o_orderkey""",
)
def join_gold(spark, sf):
    gold = spark_sql(spark, sf, "SELECT o_orderkey AS id, o_orderstatus AS gold FROM @orders")
    preds = from_view(spark, sf, "runs").select("model", "id", "round", "ord")
    return E.join_gold(preds, gold)


@query(
    "guard_pairs",
    "O63",
    """SELECT id, CASE WHEN miss THEN 'missing pred_sql / gold_sql / db_id' ELSE '' END AS execution_error, CASE WHEN miss THEN 'error' END AS result_correct
FROM (SELECT ord AS id, coalesce(schema = '' OR coalesce(function_name, '') = '' OR db_id IS NULL, true) AS miss FROM $items)""",
)
def guard_pairs(spark, sf):
    pairs = from_view(spark, sf, "items").select(
        F.col("ord").alias("id"),
        F.col("schema").alias("pred_sql"),
        F.col("function_name").alias("gold_sql"),
        "db_id",
    )
    return E.guard_pairs(pairs).select("id", "execution_error", "result_correct")


@query(
    "only_models",
    "O7",
    "SELECT model, id, round, ord FROM $runs WHERE model IN ('m_A', 'm_R')",
)
def only_models(spark, sf):
    runs = from_view(spark, sf, "runs").select("model", "id", "round", "ord")
    return only(runs, ["m_A", "m_R", "m_A", "m_unknown"])


@query(
    "normalize_models",
    "O59",
    """SELECT n.category, n.name, e.id FROM $errors e JOIN $model_names n ON e.model = n.model""",
)
def normalize_models(spark, sf):
    errors = from_view(spark, sf, "errors").select("model", "id")
    named = E.normalize_models(errors, from_view(spark, sf, "model_names"))
    return named.select("category", "name", "id")


MERGED = """SELECT coalesce(a.model, b.model) AS model, a.n AS "execution.total_sql", b.n AS "answers.n"
FROM (SELECT model, count(*) AS n FROM $runs GROUP BY model) a
FULL JOIN (SELECT CASE WHEN source IN ('src0', 'src1') THEN 'm_' || lang ELSE 'm_A' END AS model, count(*) AS n FROM @documents GROUP BY 1) b ON a.model = b.model"""


def _summaries(spark, sf):
    runs = from_view(spark, sf, "runs").groupBy("model").agg(F.count("*").alias("total_sql"))
    answers = spark_sql(
        spark,
        sf,
        """SELECT CASE WHEN source IN ('src0', 'src1') THEN concat('m_', lang) ELSE 'm_A' END AS model, count(*) AS n
FROM @documents GROUP BY 1""",
    )
    return merge({"execution": runs, "answers": answers})


@query("merge_summaries", "O60", MERGED)
def merge_summaries(spark, sf):
    return _summaries(spark, sf)


@query("report_table", "O12", MERGED)
def report_table(spark, sf):
    return table(_summaries(spark, sf))


@query(
    "resource_usage",
    "O105",
    """SELECT model, count(*) AS sample_count, round(sum(duration), 3) AS total_duration_sec,
  round(sum(duration) / nullif(count(*) - 1, 0), 3) AS average_duration_sec, round(sum(duration) / count(*), 3) AS mean_duration_sec,
  CAST(sum(tokens_used) AS BIGINT) AS total_tokens_used, round(CAST(sum(tokens_used) AS DOUBLE) / count(*), 3) AS average_tokens_per_sample
FROM $runs GROUP BY model""",
)
def resource_usage(spark, sf):
    return M.resource_usage(from_view(spark, sf, "runs"))
