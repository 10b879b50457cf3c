"""The numbered queries over the given tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm import (
    block_naming,
    chat_masks,
    cotraining,
    decontaminate,
    divergence,
    language_id,
    pii_boosting,
    simhash_index,
    swap_packing,
    token_output,
    url_rules,
    vector_codes,
    warc_revisit,
)
from scoreframe.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_window_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL["op2_window_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bi AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0
), bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM bi),
sizes AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (
  SELECT doc_id, di.n, i, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM di) di
  JOIN bw ON bw.n = di.n AND bw.win = di.win
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op3_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swap_packing.pack(table(spark, sf_dir, "documents"))


@query
def op7_simhash_byte_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_index.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_duplicates(table(spark, sf_dir, "documents"))


SQL["op9_block_naming"] = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""


@query
def op10_ftrl_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, ~language_id.held_out(F.col("doc_id")))
    found = language_id.predict(docs, model, carry=["doc_id"])
    return found.select("row.doc_id", language_id.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op1_segment_tree_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.written(table(spark, sf_dir, "documents"))


@query
def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    manifest = warc_revisit.write_archives(pages)
    records = warc_revisit.read_archives(manifest, pages.schema["page_id"].dataType.simpleString())
    return warc_revisit.resolve(records)


SQL["op4_warc_revisits"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT body, max(page_id) AS first FROM p GROUP BY body),
d AS (SELECT p.page_id, strlen(p.body) AS payload_bytes, sha1(p.body) AS hex, g.first FROM p JOIN g USING (body))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, CAST(k // 8 * 10 + 1 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS INT)) & 31 AS INT) + 1, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""


@query
def op6_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    mined = url_rules.mine_rules(url_rules.labelled_pages(pages, table(spark, sf_dir, "labels")))
    return url_rules.judge(pages, mined).select("page_id", "host", "path", "rule", "verdict")


@query
def op5_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [table(spark, sf_dir, t) for t in ("documents", "labels", "pages")]
    return cotraining.score(*tables)


@query
def op8_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_boosting.find(table(spark, sf_dir, "documents"))
    counts = [F.size(pii_boosting.of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in pii_boosting.KINDS]
    base, spans = pii_boosting.digest(F.col("base")), pii_boosting.digest(F.col("spans"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


@query
def op11_value_dictionary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    sums = vector_codes.label_errors(found)
    rows = found.alias("f").join(sums.alias("s"), F.expr("f.label <=> s.label"))
    return rows.select(
        F.col("f.id").alias("vec_id"), vector_codes.hex_code(F.col("f.codes")).alias("code"), "f.error", "s.label_error",
        F.lit(books.digest()).alias("codebooks_sha256"),
    )


def _codes_sql() -> str:
    """The same rounds, written out: parts, start, then assignment and means six times."""
    assign = """a{k} AS MATERIALIZED (
  SELECT vec_id, p, any_value(x) AS x, min(d * 16 + e) % 16 AS e, min(d * 16 + e) // 16 AS d FROM (
    SELECT v.vec_id, v.p, v.x, b.e, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.c[i]) * (v.x[i] - b.c[i])))::BIGINT AS d
    FROM v JOIN b{k} b USING (p)) GROUP BY vec_id, p)"""
    mean = """m{k} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, e, i, (s - ((s % n) + n) % n) // n AS m FROM (
      SELECT p, e, i, sum(y)::BIGINT AS s, count(*) AS n FROM (
        SELECT p, e, unnest(x) AS y, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY p, e, i)) GROUP BY p, e),
b{n} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (p, e))"""
    rounds = ",\n".join(f"{assign.format(k=k)},\n{mean.format(k=k, n=k + 1)}" for k in range(6))
    return f"""
WITH w AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (
  SELECT vec_id, p, x[p * (len(x) // 8) + 1 : (p + 1) * (len(x) // 8)] AS x FROM w, (SELECT unnest(range(8)) AS p)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM w ORDER BY vec_id LIMIT 16)),
b0 AS MATERIALIZED (SELECT p, e, x AS c FROM v JOIN s USING (vec_id)),
{rounds},
{assign.format(k=6)},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b6),
r AS (SELECT vec_id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM r JOIN w USING (vec_id), h
"""


SQL["op11_value_dictionary_codes"] = _codes_sql()


@query
def op12_transducer_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


SQL["op12_transducer_divergence"] = r"""
WITH d AS MATERIALIZED (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
kept AS MATERIALIZED (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 10),
voc AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS MATERIALIZED (SELECT lang, source, coalesce(any_value(v), 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN voc USING (lang) GROUP BY lang, source),
cnt AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN kept USING (lang, term) GROUP BY ALL),
dense AS MATERIALIZED (
  SELECT lang, source, term, coalesce(n, 0) AS n, v FROM (SELECT g.lang, g.source, k.term, g.v FROM grp g JOIN kept k USING (lang)) LEFT JOIN cnt USING (lang, source, term)),
p AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p,
    1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM dense),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
telling AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM telling)
  WHERE rank <= 10)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked
"""


@query
def op13_offset_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    planted = planted.select([F.col(f.name).cast(f.dataType) for f in conversations.schema])
    return chat_masks.read_back(chat_masks.format_conversations(conversations.unionByName(planted)))


SQL["op13_offset_masks"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|/TURN\])', '\1\\\2\3', 'g')) + CASE role
    WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
    ELSE 20 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|/TURN\])', '\1\\\2\3', 'g')) END AS shown FROM c),
a AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss, sum(shown) AS shown
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(shown AS BIGINT) AS formatted_chars FROM a
"""
