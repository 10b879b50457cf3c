"""Text cleaning over whole answers."""

from pyspark.sql import functions as F

from ..functions import text as X
from .registry import from_view, query, spark_sql

KEYWORDS = "SELECT|WITH|UPDATE|DELETE|INSERT|CREATE|DROP|ALTER"
# The blanks that occur in the given texts.
WS = "(' ' || chr(9) || chr(10) || chr(13))"
THINK = f"trim(regexp_replace(raw, '<think>.*?</think>', '', 'gis'), {WS})"
TOLERANT = (
    "trim(regexp_replace(regexp_replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), "
    "'<\\s*think\\b[^>]*>.*?<\\s*/\\s*think\\s*>', '', 'gis'), "
    f"'<\\s*think\\b[^>]*>.*$', '', 'is'), {WS})"
)
TOKEN = "'(?is)^(?:.*[^\\p{L}\\p{N}_])?(A|B|C|D|True|False)(?:[^\\p{L}\\p{N}_]|$)'"

# Stages of the extraction over cleaned text t; null where a stage does not match.
STAGES = f"""
SELECT id, t,
  CASE WHEN len(regexp_extract_all(t, '(?i)```(?:sql)?\\s*([\\s\\S]*?)```', 1)) > 0
       THEN trim(regexp_extract_all(t, '(?i)```(?:sql)?\\s*([\\s\\S]*?)```', 1)[-1], {WS}) END AS s1,
  CASE WHEN contains(regexp_replace(t, '`+$', ''), '```')
       THEN trim(regexp_extract(regexp_replace(t, '`+$', ''), '(?i)```(?:sql)?\\s*([\\s\\S]*)$', 1), {WS}) END AS s2,
  trim(regexp_extract_all(t, '(?i)((?:{KEYWORDS})\\b[\\s\\S]*?;)\\s*(?:\\r?\\n|$)', 1)[-1], {WS}) AS s3,
  trim(regexp_extract_all(t, '(?i)((?:{KEYWORDS})\\b[^\\n]*)', 1)[-1], {WS}) AS s4
FROM (SELECT id, {THINK.replace("raw", "pred_sql")} AS t FROM $sqltext)
"""


def _answers(spark, sf):
    return from_view(spark, sf, "answers")


def _sql(spark, sf):
    return from_view(spark, sf, "sqltext")


@query("strip_think", "O29", f"SELECT id, {THINK.replace('raw', 'raw_answer')} AS cleaned FROM $answers")
def strip_think(spark, sf):
    return _answers(spark, sf).select("id", X.strip_think("raw_answer").alias("cleaned"))


@query(
    "strip_think_tolerant",
    "O30",
    f"SELECT id, {TOLERANT.replace('raw', 'raw_answer')} AS cleaned FROM $answers",
)
def strip_think_tolerant(spark, sf):
    return _answers(spark, sf).select("id", X.strip_think("raw_answer", True).alias("cleaned"))


@query("tail", "O31", f"SELECT doc_id, right(trim(text, {WS}), 240) AS ending FROM @documents")
def tail(spark, sf):
    return spark_sql(spark, sf, "SELECT doc_id, text FROM @documents").select(
        "doc_id", X.tail("text").alias("ending")
    )


@query(
    "final_answer",
    "O32",
    f"""SELECT id, CASE WHEN length(a) = 1 THEN upper(a) WHEN a = '' THEN '' ELSE upper(a[1]) || lower(a[2:]) END AS answer
FROM (SELECT id, regexp_extract(right({TOLERANT.replace('raw', 'raw_answer')}, 240), {TOKEN}, 1) AS a FROM $answers)""",
)
def final_answer(spark, sf):
    return _answers(spark, sf).select("id", X.final_answer("raw_answer").alias("answer"))


def _stage(name, covers, column, fn):
    @query(name, covers, f"SELECT id, {column} AS found FROM ({STAGES})")
    def run(spark, sf):
        return _sql(spark, sf).select("id", fn(X.strip_think("pred_sql")).alias("found"))


_stage("last_fence", "O33", "s1", X.last_fence)
_stage("open_fence", "O34", "s2", X.open_fence)
_stage("last_statement", "O35", "s3", X.last_statement)
_stage("last_keyword_line", "O36", "s4", X.last_keyword_line)


@query("extract_sql", "O37", f"SELECT id, coalesce(s1, s2, s3, s4, '') AS sql_text FROM ({STAGES})")
def extract_sql(spark, sf):
    return _sql(spark, sf).select("id", X.extract_sql("pred_sql").alias("sql_text"))


@query(
    "strip_fences",
    "O38",
    f"""SELECT id, trim(trim(CASE WHEN right(a, 3) = '```' THEN trim(a[:-4], {WS}) ELSE a END, '"'), chr(39)) AS stored
FROM (SELECT id, CASE WHEN starts_with(pred_sql, '```sql') THEN trim(pred_sql[7:], {WS})
                      WHEN starts_with(pred_sql, '```') THEN trim(pred_sql[4:], {WS}) ELSE pred_sql END AS a FROM $sqltext)""",
)
def strip_fences(spark, sf):
    return _sql(spark, sf).select("id", X.strip_fences("pred_sql").alias("stored"))


@query(
    "clean_label",
    "O39",
    f"""SELECT id, trim(split_part(trim(trim(trim(trim(response, {WS}), '`'), '"'), chr(39)), chr(10), 1), {WS}) AS label
FROM $errors""",
)
def clean_label(spark, sf):
    return from_view(spark, sf, "errors").select("id", X.clean_label("response").alias("label"))


@query(
    "type_key",
    "O40",
    """SELECT p_partkey, coalesce(nullif(trim(regexp_replace(upper(trim(p_type || ' / ' || p_brand || '!')), '[^A-Z0-9]+', '_', 'g'), '_'), ''), 'UNKNOWN') AS tkey
FROM @part""",
)
def type_key(spark, sf):
    parts = spark_sql(
        spark, sf, "SELECT p_partkey, concat(p_type, ' / ', p_brand, '!') AS t FROM @part"
    )
    return parts.select("p_partkey", X.type_key("t").alias("tkey"))


@query(
    "norm_answer",
    "O41",
    f"""SELECT id, array_to_string(list_filter(list_transform(string_split(upper(gold_answer), ','), lambda x: trim(x, {WS})), lambda x: x <> ''), ',') AS mcq,
  upper(trim(gold_answer, {WS})) AS tf FROM $answers""",
)
def norm_answer(spark, sf):
    return _answers(spark, sf).select(
        "id", X.norm_answer("gold_answer").alias("mcq"), X.norm_answer("gold_answer", "tf").alias("tf")
    )


@query(
    "norm_ident",
    "O42",
    """SELECT c_custkey, lower(trim(trim(' "' || c_name || '" '), '"')) AS ident FROM @customer""",
)
def norm_ident(spark, sf):
    names = spark_sql(spark, sf, """SELECT c_custkey, concat(' "', c_name, '" ') AS n FROM @customer""")
    return names.select("c_custkey", X.norm_ident("n").alias("ident"))


@query(
    "sanitize_sql",
    "O43",
    # One alternation: whichever token starts first hides the others.
    r"""SELECT id, regexp_replace(pred_sql, '/\*.*?\*/|--[^\n\r]*|''(?:[^'']|'''')*''|[$][$].*?[$][$]', ' ', 'gs') AS clean
FROM $sqltext""",
)
def sanitize_sql(spark, sf):
    from ..functions.sqltext import sanitize_sql as sanitize

    return _sql(spark, sf).select("id", sanitize("pred_sql").alias("clean"))


@query(
    "wrap_reasoning",
    "O28",
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE '<think>' || chr(10) || role || chr(10) || '</think>' || chr(10) || chr(10) || text END AS wrapped,
  CASE WHEN role = 'user' THEN text ELSE role || text END AS unwrapped FROM @conversations""",
)
def wrap_reasoning(spark, sf):
    turns = spark_sql(
        spark, sf, "SELECT conv_id, turn, text, CASE WHEN role <> 'user' THEN role END AS r FROM @conversations"
    )
    return turns.withColumn("wrapped", X.wrap_reasoning("text", "r")).select(
        "conv_id", "turn", "wrapped", X.unwrap_reasoning("wrapped").alias("unwrapped")
    )
