"""Run planning, keys, resume, prompts and user callables."""

from pyspark.sql import functions as F

from ..operators import prompts as P
from ..operators import runs as R
from .registry import from_view, query, spark_sql

MODELS = ["m_A", "m_B", "m_A"]


def text_sql(template: str, **columns: str) -> str:
    """A prompt template as an SQL expression with its places filled by SQL."""
    parts = []
    rest = template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [before, None, columns[name]]
    parts.append(rest)
    out, is_sql = [], False
    for p in parts:
        if p is None:
            is_sql = True
        elif is_sql:
            out.append(p)
            is_sql = False
        else:
            out.append("'" + p.replace("'", "''") + "'")
    return " || ".join(out)


@query(
    "expand_rounds",
    "O14",
    """SELECT c_custkey, m AS model, CAST(r AS INTEGER) AS round FROM @customer, (SELECT unnest(['m_A', 'm_B']) AS m), range(1, 6) t(r)""",
)
def expand_rounds(spark, sf):
    items = spark_sql(spark, sf, "SELECT c_custkey FROM @customer")
    return R.expand_rounds(items, 5, MODELS)


@query(
    "unique_key_syntax",
    "O15",
    """SELECT id, round, ord, md5(id || '__' || function || '__' || coalesce(CASE WHEN round < 7 THEN question END, 'None') || '__' || round) AS k FROM $runs""",
)
def unique_key_syntax(spark, sf):
    runs = from_view(spark, sf, "runs").withColumn("q", F.expr("CASE WHEN round < 7 THEN question END"))
    return runs.select("id", "round", "ord", R.unique_key("id", "function", "q", "round").alias("k"))


@query(
    "unique_key_knowledge",
    "O16",
    """SELECT new_id, ord, md5(new_id || '__' || coalesce(function_name, 'None') || '__' || schema || '__1') AS k FROM $items""",
)
def unique_key_knowledge(spark, sf):
    items = from_view(spark, sf, "items")
    return items.select(
        "new_id", "ord", R.unique_key("new_id", "function_name", "schema", F.lit(1)).alias("k")
    )


@query(
    "unique_key_schema",
    "O17",
    """SELECT o_orderkey, md5(coalesce(nid, o_orderkey) || '__' || coalesce(fids, 'None') || '__' || coalesce(nullif(en, ''), q) || '__3') AS k FROM (
  SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS nid,
    CASE WHEN o_custkey % 4 > 0 THEN o_orderstatus || ',' || o_orderpriority END AS fids,
    CASE WHEN o_custkey % 5 > 0 THEN o_orderpriority ELSE '' END AS en, 'other ' || o_orderstatus AS q FROM @orders)""",
)
def unique_key_schema(spark, sf):
    items = spark_sql(
        spark,
        sf,
        """SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS nid,
  CASE WHEN o_custkey % 4 > 0 THEN array(o_orderstatus, o_orderpriority) END AS fids,
  CASE WHEN o_custkey % 5 > 0 THEN o_orderpriority ELSE '' END AS en, concat('other ', o_orderstatus) AS q FROM @orders""",
    )
    key = R.schema_key(*[F.col(c) for c in ("nid", "o_orderkey", "fids", "en", "q")], F.lit(3))
    return items.select("o_orderkey", key.alias("k"))


@query(
    "stable_key",
    "O18",
    """SELECT id, coalesce(nullif(unique_key, ''), md5(id || '__' || round || '__' || model)) AS k FROM $errors""",
)
def stable_key(spark, sf):
    rows = from_view(spark, sf, "errors")
    key = R.stable_key(*[F.col(c) for c in ("unique_key", "id", "round", "model")])
    return rows.select("id", key.alias("k"))


def _tasks(spark, sf):
    items = spark_sql(spark, sf, "SELECT o_orderkey AS id FROM @orders")
    return R.expand_rounds(items, 5).withColumn("unique_key", R.unique_key("id", "round"))


@query(
    "pending",
    "O19",
    """SELECT id, CAST(round AS INTEGER) AS round FROM (
  SELECT o_orderkey AS id, r AS round, md5(o_orderkey || '__' || r) AS k FROM @orders, range(1, 6) t(r))
WHERE k NOT IN (SELECT unique_key FROM $runs WHERE unique_key IS NOT NULL)""",
)
def pending(spark, sf):
    return R.pending(_tasks(spark, sf), from_view(spark, sf, "runs")).select("id", "round")


@query(
    "pending_labelled",
    "O20",
    """SELECT id, CAST(round AS INTEGER) AS round FROM (
  SELECT o_orderkey AS id, r AS round, md5(o_orderkey || '__' || r) AS k FROM @orders, range(1, 6) t(r))
WHERE k NOT IN (SELECT unique_key FROM $runs WHERE unique_key IS NOT NULL AND error IS NOT NULL)""",
)
def pending_labelled(spark, sf):
    done = from_view(spark, sf, "runs")
    return R.pending(_tasks(spark, sf), done, done_filter=F.col("error").isNotNull()).select(
        "id", "round"
    )


WS = "(' ' || chr(10))"


@query(
    "prompt_mcq",
    "O21",
    f"""SELECT p_partkey, trim({text_sql(P.MCQ_PROMPT, question="p_name", options="('A. ' || p_brand || chr(10) || 'B. ' || p_type)")}, {WS}) AS prompt FROM @part""",
)
def prompt_mcq(spark, sf):
    items = spark_sql(
        spark, sf, "SELECT p_partkey, p_name, map('A', p_brand, 'B', p_type) AS options FROM @part"
    )
    return items.select(
        "p_partkey", P.prompt_mcq(F.col("p_name"), F.col("options")).alias("prompt")
    )


@query(
    "prompt_tf",
    "O22",
    f"SELECT doc_id, trim({text_sql(P.TF_PROMPT, question='text')}, {WS}) AS prompt FROM @documents",
)
def prompt_tf(spark, sf):
    docs = spark_sql(spark, sf, "SELECT doc_id, text FROM @documents")
    return docs.select("doc_id", P.prompt_tf(F.col("text")).alias("prompt"))


@query(
    "prompt_sql",
    "O23",
    f"SELECT doc_id, trim({text_sql(P.SQL_PROMPT, question='text')}, {WS}) AS prompt FROM @documents",
)
def prompt_sql(spark, sf):
    docs = spark_sql(spark, sf, "SELECT doc_id, text FROM @documents")
    return docs.select("doc_id", P.prompt_sql(F.col("text")).alias("prompt"))


@query(
    "prompt_schema_sql",
    "O24",
    f"""SELECT ord, trim({text_sql(P.SCHEMA_SQL_PROMPT, schema="schema", question="coalesce(nullif(function_name, ''), db_id, '')")}, {WS}) AS prompt FROM $items""",
)
def prompt_schema_sql(spark, sf):
    items = from_view(spark, sf, "items")
    prompt = P.prompt_schema_sql(F.col("schema"), F.col("function_name"), F.col("db_id"))
    return items.select("ord", prompt.alias("prompt"))


@query(
    "prompt_error",
    "O25",
    f"SELECT doc_id, {text_sql(P.ERROR_PROMPT, error='left(text, 4000)')} AS prompt FROM @documents",
)
def prompt_error(spark, sf):
    docs = spark_sql(spark, sf, "SELECT doc_id, text FROM @documents")
    return docs.select("doc_id", P.prompt_error(F.col("text"), max_chars=4000).alias("prompt"))


def answer_stub(prompt: str) -> tuple[str, int]:
    """Stands for a model: answers from the prompt alone, fails on request."""
    if prompt.startswith("user"):
        raise ValueError("no user turns")
    if prompt.startswith("system"):
        raise ConnectionError("Timeout while reading")
    return f"```sql\nSELECT {len(prompt)}\n```", len(prompt)


@query(
    "batch_predict",
    "O26",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN '' WHEN 'system' THEN '' ELSE 'SELECT ' || length(role || ': ' || text) END AS pred_sql,
  CASE role WHEN 'user' THEN 0 WHEN 'system' THEN 0 ELSE length(role || ': ' || text) END AS tokens_used,
  CASE role WHEN 'user' THEN 'ValueError: no user turns' WHEN 'system' THEN 'failed after 3 attempts: Timeout while reading' END AS error,
  true AS timed FROM @conversations""",
)
def batch_predict(spark, sf):
    turns = spark_sql(
        spark, sf, "SELECT conv_id, turn, concat(role, ': ', text) AS prompt FROM @conversations"
    )
    made = R.as_stored(R.batch_predict(turns, answer_stub, delay=0.0))
    timed = (F.col("timestamp") >= F.col("start_time")) & (F.col("duration") >= 0)
    return made.select("conv_id", "turn", "pred_sql", "tokens_used", "error", timed.alias("timed"))


def embed_stub(texts: list[str]) -> tuple[list[list[float]], int]:
    """Stands for an embedding model: length and number of words; refuses texts that shout."""
    if any("!!" in t for t in texts):
        raise ValueError("no shouting")
    return [[float(len(t)), float(t.count(" ") + 1)] for t in texts], sum(map(len, texts))


@query(
    "batch_embed",
    "O27",
    """SELECT doc_id, CASE WHEN NOT bad THEN CAST(length(text) AS FLOAT) END AS v0, CASE WHEN NOT bad THEN CAST(len(string_split(text, ' ')) AS FLOAT) END AS v1,
  CASE WHEN bad THEN 'ValueError: no shouting' END AS embed_error, CASE WHEN bad THEN 0 ELSE length(text) END AS embed_tokens FROM (SELECT *, contains(text, '!!') AS bad FROM @documents)""",
)
def batch_embed(spark, sf):
    docs = spark_sql(spark, sf, "SELECT doc_id, text FROM @documents")
    # One text per call, so that the tokens can be told row by row.
    made = R.batch_embed(docs, embed_stub, batch_size=1)
    return made.select(
        "doc_id", F.col("vector")[0].alias("v0"), F.col("vector")[1].alias("v1"), "embed_error", "embed_tokens"
    )
