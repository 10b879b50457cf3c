"""JSON-Lines scans of prediction, item, signature and summary files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

CORRUPT = "_corrupt_record"


def read_predictions(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str,
    mode: str = "FAILFAST",
    bom: bool = False,
) -> DataFrame:
    """Scan JSON-Lines with a fixed schema.

    ``FAILFAST`` stops at a bad line, ``DROPMALFORMED`` skips it; blank lines are
    always skipped. ``bom=True`` also drops a byte-order mark in front of a line.
    """
    if not bom:
        return spark.read.schema(schema).option("mode", mode).json(path)
    if mode == "DROPMALFORMED":
        return _parse_lines(spark, path, schema)[0]
    failed = F.raise_error(F.concat(F.lit("malformed line: "), F.col("_line"))).cast("boolean")
    checked = F.when(F.col(CORRUPT).isNotNull(), failed).otherwise(True)
    return _all_lines(spark, path, schema).where(checked).drop(CORRUPT, "_line", "_file")


def read_with_rejects(
    spark: SparkSession, path: str | Sequence[str], schema: str
) -> tuple[DataFrame, DataFrame]:
    """Scan JSON-Lines into (good rows, rejected lines with their file)."""
    return _parse_lines(spark, path, schema)


def _all_lines(spark, path, schema) -> DataFrame:
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    line = F.regexp_replace("value", "^\ufeff", "")
    return (
        spark.read.text(path)
        .select(line.alias("_line"), F.col("_metadata.file_path").alias("_file"))
        .where(F.trim(F.regexp_replace("_line", r"\s+", " ")) != "")
        .select(
            "_line",
            "_file",
            F.from_json(
                "_line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
            ).alias("_r"),
        )
        .select("_line", "_file", "_r.*")
    )


def _parse_lines(spark, path, schema) -> tuple[DataFrame, DataFrame]:
    lines = _all_lines(spark, path, schema)
    good = lines.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "_line", "_file")
    bad = lines.where(F.col(CORRUPT).isNotNull()).select(
        F.col("_file").alias("file"), F.col("_line").alias("line")
    )
    return good, bad


def read_json_array(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file, idx, item``: the objects of files that are one JSON array of objects each, as texts.

    A file is read in blocks, cut behind every closing brace. Whether a cut lies in a quoted text, and how deep, depends on all
    that is in front of it: each block says what it does to either state, those sums are put together per file, and the cuts
    of a block then know where they stand. So one long file is the work of many tasks, and only an element's own text
    meets in one place. A file that isn't such an array raises.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.regexp_replace("value", "^\ufeff", "").alias("value"),
    )
    # Escaped characters count for nothing; what is left of quoted texts goes by how the piece begins.
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    outside = lambda t: F.regexp_replace(t, r'"[^"]*(?:"|\z)', "")
    level = lambda t: F.length(F.regexp_replace(t, r"[^{\[]", "")) - F.length(F.regexp_replace(t, r"[^}\]]", ""))
    near = Window.partitionBy("file", "block").orderBy("row")
    before = near.rowsBetween(Window.unboundedPreceding, -1)
    cut = pieces.withColumn("_bare", bare).select(
        "file", "block", "row", "value",
        F.length(F.regexp_replace("_bare", '[^"]', "")).alias("quotes"),
        level(outside(F.col("_bare"))).alias("plain"),
        level(outside(F.regexp_replace("_bare", r'\A[^"]*(?:"|\z)', ""))).alias("quoted"),
    )
    cut = cut.withColumn("_in", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    # What a piece and the brace behind it add to the depth, for a block that begins outside a quoted text or inside one.
    for name, flip in (("_out0", 0), ("_out1", 1)):
        inside = (F.col("_in") + flip) % 2 == 1
        ends_inside = (F.col("_in") + flip + F.col("quotes")) % 2 == 1
        cut = cut.withColumn(name, F.when(inside, F.col("quoted")).otherwise(F.col("plain")) - F.when(ends_inside, 0).otherwise(1))
    sums = cut.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("odd"), F.sum("_out0").alias("d0"), F.sum("_out1").alias("d1"))
    listed = sums.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "odd", "d0", "d1"))).alias("_b"))
    # A file has few blocks; the state in front of each is a fold over those before it.
    states = """aggregate(_b, named_struct('at', CAST(array() AS ARRAY<STRUCT<block: BIGINT, odd: BIGINT, depth: BIGINT>>), 'odd', 0L, 'depth', 0L),
      (s, b) -> named_struct('at', concat(s.at, array(named_struct('block', b.block, 'odd', s.odd, 'depth', s.depth))),
        'odd', (s.odd + b.odd) % 2, 'depth', s.depth + IF(s.odd = 0, b.d0, b.d1)))"""
    states = listed.select("file", F.expr(states).alias("_s"))
    # The last piece has no brace behind it, which was counted all the same.
    whole = (F.col("_s.odd") == 0) & (F.col("_s.depth") == -1)
    broken = F.raise_error(F.concat(F.lit("no JSON array of objects: "), F.col("file")))
    states = states.select("file", F.explode(F.when(whole, F.col("_s.at")).otherwise(broken)).alias("_p"))
    states = states.select("file", F.col("_p.block").alias("block"), F.col("_p.odd").alias("_odd"), F.col("_p.depth").alias("_depth"))
    known = cut.join(states, ["file", "block"])
    step = F.when(F.col("_odd") == 0, F.col("_out0")).otherwise(F.col("_out1"))
    depth = F.col("_depth") + F.sum(step).over(near.rowsBetween(Window.unboundedPreceding, 0))
    ends = (depth == 1) & ((F.col("_in") + F.col("_odd") + F.col("quotes")) % 2 == 0)
    known = materialize(known.select("file", "block", "row", "value", ends.cast("int").alias("_end")), "pieces")
    far = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = known.groupBy("file", "block").agg(F.sum("_end").alias("_n"))
    firsts = firsts.select("file", "block", F.coalesce(F.sum("_n").over(far), F.lit(0)).alias("_first"))
    idx = F.col("_first") + F.coalesce(F.sum("_end").over(before), F.lit(0))
    numbered = known.join(firsts, ["file", "block"]).withColumn("idx", idx.cast("int"))
    items = numbered.groupBy("file", "idx").agg(
        F.array_sort(F.collect_list(F.struct("block", "row", "value"))).alias("_v"), F.max("_end").alias("_whole")
    )
    text = F.array_join(F.transform("_v", lambda v: v["value"]), "}")
    lead = F.when(F.col("idx") == 0, r"\[").otherwise(",")
    tail = F.when(F.col("idx") == 0, r"\A\s*\[\s*\]\s*\z").otherwise(r"\A\s*\]\s*\z")
    items = items.select("file", "idx", "_whole", text.alias("_t"), lead.alias("_lead"), tail.alias("_tail"))
    item = F.regexp_extract("_t", r"(?s)\A\s*[\[,]\s*(\{.*)\z", 1)
    fits = F.when(F.col("_whole") == 1, F.regexp_like("_t", F.concat(F.lit(r"(?s)\A\s*"), F.col("_lead"), F.lit(r"\s*\{.*"))))
    fits = fits.otherwise(F.regexp_like("_t", F.col("_tail")))
    checked = items.where(F.when(fits, F.col("_whole") == 1).otherwise(broken.cast("boolean")))
    return checked.select("file", "idx", F.concat(item, F.lit("}")).alias("item"))


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """Scan JSON arrays of function signatures; ``sig_ord`` is the listed order in its file.

    ``variadic`` may be a JSON boolean or the text "True"/"False". A file is split between tasks, see :func:`read_json_array`.
    """
    fields = "struct<function_name: string, input_types: array<string>, variadic: string>"
    rows = read_json_array(spark, path).select(F.from_json("item", fields).alias("s"), F.col("idx").alias("sig_ord"))
    return rows.select(
        "s.function_name",
        "s.input_types",
        (F.lower(F.coalesce("s.variadic", F.lit("false"))) == "true").alias("variadic"),
        "sig_ord",
    )


def read_runs(
    spark: SparkSession, base: str, filename: str, schema: str, mode: str = "FAILFAST"
) -> DataFrame:
    """Scan ``base/<model>/<filename>`` of every model directory in one job.

    The directory names the model; a directory without the file is no input.
    """
    runs = spark.read.schema(schema).option("mode", mode).json(f"{base}/*/{filename}")
    return runs.withColumn("model", _model_of_file(base))


def _model_of_file(base: str) -> Column:
    """The path component behind ``base`` in the file name of a row."""
    name = base.rstrip("/").rsplit("/", 1)[-1]
    path = F.coalesce(F.try_url_decode(F.col("_metadata.file_path")), F.col("_metadata.file_path"))
    return F.regexp_extract(path, rf"/\Q{name}\E/([^/]+)/", 1)


def read_summaries(spark: SparkSession, base: str, filename: str) -> DataFrame:
    """One row per model directory that has ``filename``: (model, summary, parse_error).

    ``summary`` is a VARIANT object; text that is no JSON object is reported.
    """
    raw = spark.read.text(f"{base}/*/{filename}", wholetext=True)
    parsed = raw.select(_model_of_file(base).alias("model"), F.try_parse_json("value").alias("v"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return parsed.select(
        "model",
        F.when(is_object, F.col("v")).alias("summary"),
        F.when(F.col("v").isNull(), F.lit("summary is not valid JSON"))
        .when(~is_object, F.lit("summary is not a JSON object"))
        .alias("parse_error"),
    )


def only_models(df: DataFrame, names: Sequence[str], column: str = "model") -> DataFrame:
    """Keep the active models; repeated names count once."""
    return df.where(F.col(column).isin(list(dict.fromkeys(names))))


def with_ingest_order(df: DataFrame, name: str = "ord") -> DataFrame:
    """Add the position of each row in its file as a sortable struct.

    Must be called on a file scan. ``pos`` only has to grow within one file
    block, which a task always reads front to back, so the key is the same
    however the scan is split into tasks.
    """
    return df.withColumn(
        name,
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"),
        ),
    )
