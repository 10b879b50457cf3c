"""Scans and sinks. Files are written from the given tables, then read."""

from pyspark.sql import functions as F

from .. import sources as IO
from ..session import shared_dir, tasks_for
from ..streaming import append_new, follow_runs
from .errors import NAMED
from .errors import error_long as long_report
from .registry import from_view, query

SCHEMA = "model STRING, id STRING, round INT, unique_key STRING, error STRING, duration DOUBLE, tokens_used BIGINT, ord BIGINT"
COLUMNS = ["model", "id", "round", "unique_key", "error", "duration", "tokens_used", "ord"]
RUNS = "SELECT model, CAST(id AS VARCHAR) AS id, round, unique_key, error, duration, tokens_used, ord FROM $runs"
MODELS = ["m_A", "m_N", "m_R"]


def _runs(spark, sf):
    return from_view(spark, sf, "runs").select(*COLUMNS)


def _lines(spark, sf, mark=""):
    """JSON lines with a blank line or a broken one behind some of them."""
    rows = _runs(spark, sf)
    line = F.concat(F.lit(mark), F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"}))
    extra = F.when(F.col("tokens_used") % 10 == 0, F.lit("  ")).when(
        F.col("tokens_used") % 10 == 1, F.left(line, F.length(line) - 9)
    )
    return rows.select(F.explode(F.array_compact(F.array(line, extra))).alias("value"))


def _write_text(df, label):
    path = shared_dir(df.sparkSession, label)
    df.write.text(path)
    return path


@query("read_predictions", "O1 O9", RUNS)
def read_predictions(spark, sf):
    path = shared_dir(spark, "strict")
    IO.write_jsonl(_runs(spark, sf), path)
    return IO.read_predictions(spark, path, SCHEMA)


@query("read_tolerant", "O2", RUNS)
def read_tolerant(spark, sf):
    return IO.read_predictions(
        spark, _write_text(_lines(spark, sf), "tolerant"), SCHEMA, mode="DROPMALFORMED"
    )


@query(
    "read_with_rejects",
    "O3",
    f"""SELECT 'good' AS kind, model, id, round, unique_key, tokens_used FROM ({RUNS})
UNION ALL SELECT 'bad', model, id, round, unique_key, tokens_used FROM ({RUNS}) WHERE tokens_used % 10 = 1""",
)
def read_with_rejects(spark, sf):
    good, bad = IO.read_with_rejects(spark, _write_text(_lines(spark, sf), "rejects"), SCHEMA)
    names = ["model", "id", "round", "unique_key", "tokens_used"]
    # A rejected line is kept as it was; what it still shows of its fields is read with patterns.
    text = lambda c: F.nullif(F.regexp_extract("line", f'"{c}":"?([^",]*)', 1), F.lit("null")).alias(c)
    number = lambda c, t: F.regexp_extract("line", f'"{c}":([0-9]+)', 1).cast(t).alias(c)
    shown = [text("model"), text("id"), number("round", "int"), text("unique_key"), number("tokens_used", "bigint")]
    return good.select(F.lit("good").alias("kind"), *names).unionAll(bad.select(F.lit("bad"), *shown))


@query(
    "read_signatures",
    "O4",
    """SELECT function_name, types, "variadic", CAST(sig_ord % 1000 AS INTEGER) AS sig_ord FROM $signatures""",
)
def read_signatures(spark, sf):
    # One array per file, a thousand signatures each.
    sigs = from_view(spark, sf, "signatures").select(
        F.floor(F.col("sig_ord") / 1000).alias("part"),
        F.struct(
            "sig_ord",
            "function_name",
            F.split("types", ",").alias("input_types"),
            F.initcap(F.col("variadic").cast("string")).alias("variadic"),
        ).alias("s"),
    )
    arrays = sigs.groupBy("part").agg(F.to_json(F.array_sort(F.collect_list("s"))).alias("value"))
    path = shared_dir(spark, "signatures")
    arrays.repartition("part").write.partitionBy("part").text(path)
    return IO.read_signatures(spark, path).select(
        "function_name", F.array_join("input_types", ",").alias("types"), "variadic", "sig_ord"
    )


@query("read_with_bom", "O5", RUNS)
def read_with_bom(spark, sf):
    path = _write_text(_lines(spark, sf, "﻿"), "bom")
    return IO.read_predictions(spark, path, SCHEMA, mode="DROPMALFORMED", bom=True)


@query("read_runs", "O6", RUNS)
def read_runs(spark, sf):
    base = shared_dir(spark, "runs")
    for m in MODELS:
        IO.write_jsonl(
            _runs(spark, sf).where(F.col("model") == m).drop("model"), f"{base}/{m}/predictions.jsonl"
        )
    return IO.read_runs(spark, base, "predictions.jsonl", SCHEMA)


@query("file_order", "O8", "SELECT model, id, row_number() OVER (PARTITION BY model ORDER BY ord, id) AS place FROM $runs")
def file_order(spark, sf):
    from ..operators.order import running_index

    base = shared_dir(spark, "order")
    for m in MODELS:
        rows = _runs(spark, sf).where(F.col("model") == m).withColumn("id", F.col("id").cast("bigint"))
        # A sort over all tasks, as many as the rows need.
        rows = rows.repartitionByRange(tasks_for(rows), "ord", "id").sortWithinPartitions("ord", "id")
        IO.write_jsonl(rows, f"{base}/{m}")
    scan = spark.read.schema(SCHEMA.replace("id STRING", "id BIGINT", 1)).json(f"{base}/*")
    ordered = IO.with_ingest_order(scan.drop("ord"), "ord")
    return running_index(ordered, ["model"], ["ord"], "place").select("model", "id", "place")


@query(
    "write_summary",
    "O10",
    "SELECT model, count(*) AS total, sum(duration) AS seconds FROM $runs GROUP BY model",
)
def write_summary(spark, sf):
    path = shared_dir(spark, "summary")
    totals = _runs(spark, sf).groupBy("model").agg(
        F.count("*").alias("total"), F.sum("duration").alias("seconds")
    )
    IO.write_summary(totals, path)
    return spark.read.schema("total BIGINT, seconds DOUBLE, model STRING").json(path)


@query(
    "read_summaries",
    "O10 O60",
    "SELECT 'model=' || model AS model, count(*) AS total, CAST(NULL AS VARCHAR) AS parse_error FROM $runs GROUP BY model",
)
def read_summaries(spark, sf):
    path = shared_dir(spark, "summaries")
    IO.write_summary(_runs(spark, sf).groupBy("model").agg(F.count("*").alias("total")), path)
    found = IO.read_summaries(spark, path, "*.json")
    return found.select(
        "model", F.try_variant_get("summary", "$.total", "bigint").alias("total"), "parse_error"
    )


@query("write_csv", "O11", f'SELECT category, name, error_type, n AS "count" FROM ({NAMED})')
def write_csv(spark, sf):
    path = shared_dir(spark, "csv")
    IO.write_csv(long_report(spark, sf), path)
    return spark.read.schema("category INT, name STRING, error_type STRING, count BIGINT").csv(
        path, header=True
    )


@query("append_runs", "O13", RUNS)
def append_runs(spark, sf):
    path = shared_dir(spark, "append")
    rows = _runs(spark, sf)
    late = F.col("round") > 3
    IO.append_runs(rows.where(~late), path)
    IO.append_runs(rows.where(late), path)
    return spark.read.schema(SCHEMA).json(path)


@query(
    "append_new_runs",
    "O13 O19 O46",
    """SELECT model, CAST(id AS VARCHAR) AS id, round, unique_key, ord FROM (
  SELECT *, row_number() OVER (PARTITION BY model, unique_key ORDER BY round > 3, ord) AS rn FROM $runs WHERE coalesce(unique_key, '') <> '') WHERE rn = 1""",
)
def append_new_runs(spark, sf):
    base = shared_dir(spark, "stream")
    rows = _runs(spark, sf)
    late = F.col("round") > 3
    for part in (rows.where(~late), rows.where(late)):
        IO.append_runs(part, f"{base}/in", compression="lz4")
        append_new(follow_runs(spark, f"{base}/in", SCHEMA), f"{base}/store", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/store").select("model", "id", "round", "unique_key", "ord")
