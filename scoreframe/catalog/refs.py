"""Tables and columns a query refers to."""

from pyspark.sql import functions as F

from ..functions import sqltext as S
from ..operators import refs as R
from .registry import from_view, query

# Columns of the tables in the schema texts.
CATALOG = """SELECT * FROM (VALUES ('nation', 0, 'n_nationkey'), ('nation', 1, 'n_name'), ('nation', 2, 'n_regionkey'), ('region', 0, 'r_regionkey'), ('region', 1, 'r_name'),
  ('customer', 0, 'c_custkey'), ('customer', 1, 'c_name'), ('customer', 2, 'c_acctbal'), ('customer', 3, 'geom'), ('supplier', 0, 's_suppkey'), ('supplier', 1, 's_name'),
  ('supplier', 2, 's_nationkey'), ('part', 0, 'p_partkey'), ('part', 1, 'p_name')) t(tab, col_idx, col)"""


@query(
    "parse_schema",
    "O88",
    f"""SELECT i.ord, c.tab AS "table", c.col_idx, c.col AS "column" FROM $items i, ({CATALOG}) c WHERE i.schema <> ''
UNION ALL SELECT ord, split_part(split_part(schema, '# ', 7), ' ', 1), 0, 'k_' || split_part(split_part(split_part(schema, '# ', 7), ' ', 1), '_', 2) FROM $items WHERE schema <> ''
UNION ALL SELECT ord, split_part(split_part(schema, '# ', 7), ' ', 1), 1, 'note' FROM $items WHERE schema <> ''""",
)
def parse_schema(spark, sf):
    items = from_view(spark, sf, "items").select("ord", "schema")
    return R.catalog_rows(R.parse_schema(items), "ord")


# What each shape of the SQL texts refers to, by the last digit of its id.
FROMS = """(VALUES (0, 0, 'customer', 'c'), (1, 0, 'nation', 'JOIN'), (2, 0, 'supplier', 's'), (2, 1, 'nation', 'n'), (5, 0, 'part', NULL),
  (6, 0, 'customer', NULL), (8, 0, 'customer', NULL), (9, 0, 'part', 'ORDER')) f(d, pos, tab, alias)"""


@query(
    "from_tables",
    "O89",
    f"SELECT s.id, f.pos, f.tab AS \"table\", coalesce(f.alias, '-') AS alias FROM $sqltext s JOIN {FROMS} ON s.id % 10 = f.d",
)
def from_tables(spark, sf):
    rows = from_view(spark, sf, "sqltext").select(
        "id", F.posexplode(S.from_tables("pred_sql")).alias("pos", "f")
    )
    return rows.select("id", "pos", "f.table", F.coalesce("f.alias", F.lit("-")).alias("alias"))


@query(
    "qualified_columns",
    "O90",
    """SELECT s.id, f.pos, f.owner, f.col AS "column" FROM $sqltext s JOIN (VALUES (0, 0, 'c', 'c_name'), (0, 1, 'c', 'c_custkey'), (2, 0, 's', 's_name'), (2, 1, 'n', 'n_name'),
  (2, 2, 's', 's_nationkey'), (2, 3, 'n', 'n_nationkey'), (9, 0, 'public', 'part')) f(d, pos, owner, col) ON s.id % 10 = f.d""",
)
def qualified_columns(spark, sf):
    rows = from_view(spark, sf, "sqltext").select(
        "id", F.posexplode(S.qualified_columns("pred_sql")).alias("pos", "q")
    )
    return rows.select("id", "pos", "q.owner", "q.column")


@query(
    "bare_columns",
    "O91",
    """SELECT id, CASE id % 10 WHEN 0 THEN 'sql,c,customer' WHEN 1 THEN 'n_name,r_name,nation,region,n_regionkey,r_regionkey' WHEN 2 THEN 'think,x,s,n,supplier,nation' WHEN 3 THEN ''
  WHEN 4 THEN 'no,statement,here' WHEN 5 THEN 'first,p_name,part' WHEN 6 THEN 'Use,this,c_acctbal,customer,c_name' WHEN 7 THEN 'trailing,words,with' WHEN 8 THEN 'geom,numeric,customer,and,that,is,it,done' ELSE 'public,p_name,p_partkey' END AS names FROM $sqltext""",
)
def bare_columns(spark, sf):
    shown = F.array_join(F.filter(S.bare_columns("pred_sql"), lambda n: n != "SELECT"), ",")
    return from_view(spark, sf, "sqltext").select("id", shown.alias("names"))


def _with_catalog(spark, sf):
    from ..operators.enrich import attach_schema

    preds = from_view(spark, sf, "sqltext")
    items = from_view(spark, sf, "items")
    return attach_schema(preds, items, parse=True).where("schema_error IS NULL")


KNOWN = "(SELECT id FROM $sqltext WHERE id IN (SELECT new_id FROM $items WHERE schema <> ''))"
HITS = """(VALUES (0, 0, 'customer', 'c_name'), (0, 0, 'customer', 'c_custkey'), (2, 0, 'supplier', 's_name'), (2, 0, 'supplier', 's_nationkey'),
  (2, 1, 'nation', 'n_name'), (2, 1, 'nation', 'n_nationkey'), (5, 0, 'part', 'p_name'), (6, 0, 'customer', 'c_acctbal'), (6, 0, 'customer', 'c_name'),
  (8, 0, 'customer', 'geom'), (9, 0, 'part', 'p_name'), (9, 0, 'part', 'p_partkey'), (1, 0, 'nation', 'n_name'), (1, 0, 'nation', 'n_regionkey')) h(d, pos, tab, col)"""


@query(
    "resolve_columns",
    "O92",
    f"""SELECT k.id, h.tab AS "table", h.col AS "column" FROM {KNOWN} k JOIN {HITS} ON k.id % 10 = h.d""",
)
def resolve_columns(spark, sf):
    return R.resolve_columns(_with_catalog(spark, sf)).select("id", F.explode_outer("hits").alias("h")).where("h IS NOT NULL").select(
        "id", "h.table", "h.column"
    )


MANAGED = """(VALUES (3, 0, 'nation', 'n_name'), (9, 0, 'part', 'p_name'), (9, 1, 'customer', 'geom')) m(d, pos, tab, col)"""


@query(
    "management_refs",
    "O93",
    f"""SELECT k.id, m.pos, m.tab AS "table", m.col AS columns FROM {KNOWN} k JOIN {MANAGED} ON k.id % 10 = m.d""",
)
def management_refs(spark, sf):
    rows = R.management_refs(_with_catalog(spark, sf)).select(
        "id", F.posexplode_outer("mgmt_refs").alias("pos", "m")
    ).where("pos IS NOT NULL")
    return rows.select("id", "pos", "m.table", F.array_join("m.columns", ",").alias("columns"))


@query(
    "management_tables",
    "O94",
    f"""SELECT id, CASE id % 10 WHEN 3 THEN 'nation' ELSE '' END AS tables FROM {KNOWN}""",
)
def management_tables(spark, sf):
    return R.management_tables(_with_catalog(spark, sf)).select(
        "id", F.array_join("mgmt_tables", ",").alias("tables")
    )


PICKED = """SELECT id, CASE id % 10 WHEN 0 THEN 'customer(c_name,c_custkey)' WHEN 1 THEN 'nation(n_name,n_regionkey)' WHEN 2 THEN 'supplier(s_name,s_nationkey);nation(n_name,n_nationkey)'
  WHEN 3 THEN 'nation(n_name)' WHEN 5 THEN 'part(p_name)' WHEN 6 THEN 'customer(c_acctbal,c_name)' WHEN 8 THEN 'customer(geom)' WHEN 9 THEN 'part(p_name,p_partkey);customer(geom)' ELSE '' END AS picked"""


@query("pick_refs", "O95", f"{PICKED} FROM {KNOWN}")
def pick_refs(spark, sf):
    shown = F.transform(
        "tables", lambda t: F.concat(t["table"], F.lit("("), F.array_join(t["columns"], ","), F.lit(")"))
    )
    return R.pick_refs(_with_catalog(spark, sf)).select("id", F.array_join(shown, ";").alias("picked"))


# Picked references of many models: the tables of an answer come from the order's columns.
PRED_REFS = """SELECT concat('m_', l_returnflag) AS model, l_orderkey AS id, l_linenumber * 100000000 + l_partkey AS ord,
  concat('T', CAST(l_partkey % 3 AS STRING)) AS t1, concat('"c', CAST(l_suppkey % 4 AS STRING), '"') AS c1, concat('t', CAST(l_suppkey % 3 AS STRING)) AS t2, l_quantity < 5 AS blank FROM @lineitem"""
GOLD_REFS = """SELECT o_orderkey AS id, concat('t', CAST(o_custkey % 3 AS STRING)) AS t1, concat('c', CAST(o_orderkey % 4 AS STRING)) AS c1, concat('c', CAST(o_custkey % 4 AS STRING)) AS c2 FROM @orders"""
LAST_PRED = f"""SELECT model, id, arg_max(lower(t1), ord) AS t1, arg_max(trim(c1, '"'), ord) AS c1, arg_max(t2, ord) AS t2, arg_max(blank, ord) AS blank FROM ({PRED_REFS}) GROUP BY model, id"""


def _pred_refs(spark, sf):
    from .registry import spark_sql

    # Where a record lies in its table settles equal orders: the first one counts, as in the SQL.
    placed = PRED_REFS.replace(" FROM @", ", _metadata.file_path AS file, _metadata.row_index AS place FROM @")
    rows = spark_sql(spark, sf, placed)
    none = F.array().cast("array<string>")
    return rows.select(
        "model",
        "id",
        "ord",
        "file",
        "place",
        F.array(
            F.struct(F.col("t1").alias("table"), F.when(F.col("blank"), none).otherwise(F.array("c1", F.lit(" c9 "))).alias("columns")),
            F.struct(F.col("t2").alias("table"), none.alias("columns")),
        ).alias("tables"),
    )


@query(
    "ref_map",
    "O107",
    f"""SELECT model, id, ord, lower(t1) AS "table", CASE WHEN trim(c1, '"') < 'c9' THEN trim(c1, '"') || ',c9' END AS columns FROM ({PRED_REFS}) WHERE NOT blank""",
)
def ref_map(spark, sf):
    return R.ref_map(_pred_refs(spark, sf), "model", "id", "ord").withColumn(
        "columns", F.array_join("columns", ",")
    )


def _hit_sql(keep: str) -> str:
    return f"""SELECT model, count(*) AS matched_items, CAST(sum(th) AS BIGINT) AS table_hit_count, CAST(sum(tt) AS BIGINT) AS table_total_count, CAST(sum(ch) AS BIGINT) AS column_hit_count, CAST(sum(ct) AS BIGINT) AS column_total_count,
  round(CAST(sum(th) AS DOUBLE) / sum(tt), 4) AS table_hit_rate, round(CAST(sum(ch) AS DOUBLE) / sum(ct), 4) AS column_hit_rate FROM (
  SELECT p.model, 1 AS tt, CASE WHEN g.c1 = g.c2 THEN 1 ELSE 2 END AS ct, CASE WHEN NOT p.blank AND p.t1 = g.t1 THEN 1 ELSE 0 END AS th,
    CASE WHEN NOT p.blank AND p.t1 = g.t1 AND p.c1 IN (g.c1, g.c2) THEN 1 ELSE 0 END AS ch
  FROM ({LAST_PRED}) p JOIN ({GOLD_REFS}) g ON p.id = g.id WHERE {keep}) GROUP BY model"""


def _hits(spark, sf, strict):
    from .registry import spark_sql

    gold = spark_sql(spark, sf, GOLD_REFS).select(
        "id",
        F.array(F.struct(F.col("t1").alias("table"), F.array("c1", "c2").alias("columns"))).alias("tables"),
    )
    return R.hit_rates(_pred_refs(spark, sf), gold, ord_col="ord", strict=strict, ties=("file", "place"))


@query("hit_rates", "O108", _hit_sql("NOT p.blank"))
def hit_rates(spark, sf):
    return _hits(spark, sf, False)


@query("hit_rates_strict", "O108", _hit_sql("true"))
def hit_rates_strict(spark, sf):
    return _hits(spark, sf, True)
