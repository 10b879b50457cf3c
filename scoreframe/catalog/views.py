"""Input views over the given tables, in the record shapes the operators take."""

from .registry import view

# Rounds of many models. Line items repeat (order, line), so keys repeat as well.
view(
    "runs",
    """
SELECT concat('m_', l_returnflag) AS model, l_orderkey AS id, concat('ST_', l_linestatus) AS function,
       concat('question ', CAST(l_orderkey AS STRING)) AS question, l_linenumber AS round,
       CASE WHEN l_suppkey % 50 = 0 THEN '' WHEN l_suppkey % 50 = 1 THEN NULL
            ELSE md5(concat(CAST(l_orderkey AS STRING), '__', CAST(l_linenumber AS STRING))) END AS unique_key,
       CASE WHEN l_linestatus = 'F' AND l_quantity > 25 THEN 'correct'
            WHEN l_quantity < 5 THEN 'unknown' ELSE 'incorrect' END AS result_correct,
       l_quantity > 3 AS executable,
       CASE WHEN l_discount > 0.09 THEN 'timeout: no answer' WHEN l_discount < 0.01 THEN 'refused: policy' END AS error,
       l_quantity AS duration, l_partkey AS tokens_used,
       CAST(((year(l_shipdate) * 372 + month(l_shipdate) * 31 + day(l_shipdate)) * 8 + l_linenumber) AS BIGINT)
         * 10000000000 + l_partkey AS ord
FROM @lineitem
""",
)

# Answers to choice questions; two of the shapes carry the whole text of a document.
view(
    "answers",
    """
SELECT d.source AS model, d.doc_id AS id, concat(d.lang, '-', CAST(coalesce(l.toxic, 9) AS STRING)) AS type,
       CASE WHEN d.doc_id % 9 = 0 THEN ' b , a ,' ELSE substr('ABCD', CAST(d.doc_id % 4 AS INT) + 1, 1) END AS gold_answer,
       CASE d.doc_id % 8
         WHEN 0 THEN concat('<think>', d.text, ' B</think> The answer is ', substr('ABCD', CAST(d.doc_id % 4 AS INT) + 1, 1))
         WHEN 1 THEN 'B' WHEN 2 THEN 'answer: c.' WHEN 3 THEN ''
         WHEN 4 THEN concat(' the answer is D <think>unclosed A ', d.text) WHEN 5 THEN 'TRUE'
         WHEN 6 THEN concat('&lt;think class=x&gt;', d.text, '&lt;/think&gt; it is false')
         ELSE d.text END AS raw_answer,
       CASE WHEN d.doc_id % 17 = 0 THEN 'timeout' END AS error
FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id
""",
)

# Raw SQL answers.
view(
    "sqltext",
    """
SELECT o_orderkey AS id, concat('m_', o_orderstatus) AS model,
       CASE o_orderkey % 10
         WHEN 0 THEN concat('```sql', chr(10), 'SELECT c.c_name FROM customer c WHERE c.c_custkey = ', CAST(o_custkey AS STRING), ';', chr(10), '```')
         WHEN 1 THEN 'SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey;'
         WHEN 2 THEN concat('<think>x SELECT 9;</think>', chr(10), 'SELECT s.s_name, n.n_name FROM supplier s JOIN nation AS n ON s.s_nationkey = n.n_nationkey')
         WHEN 3 THEN concat('```', chr(10), 'SELECT find_srid(', chr(39), 'public', chr(39), ', ', chr(39), 'nation', chr(39), ', ', chr(39), 'n_name', chr(39), ')')
         WHEN 4 THEN 'no statement here'
         WHEN 5 THEN concat('first', chr(10), 'SELECT 1;', chr(10), 'SELECT p_name FROM part;')
         WHEN 6 THEN concat('Use this:', chr(10), 'select /* c_name, (x */ c_acctbal', chr(10), 'from customer -- nation', chr(10), 'where c_name = ', chr(39), 'it, (', CAST(o_custkey AS STRING), chr(39))
         WHEN 7 THEN concat('``` ```', chr(10), 'trailing words with ', CAST(o_custkey AS STRING))
         WHEN 8 THEN concat('SELECT ', CASE o_custkey % 3 WHEN 0 THEN concat('/* don', chr(39), 't (, */ -- it', chr(39), 's (x', chr(10)) WHEN 1 THEN concat(chr(36), chr(36), 'it', chr(39), 's (', chr(36), chr(36), ', ', chr(39), '-- ) ', chr(39), ', ') ELSE '' END, 'ST_Buffer(ST_SetSRID(geom, 4326), ', CAST(o_custkey AS STRING), '), round(', CAST(o_totalprice AS STRING), '::numeric, 2) FROM customer; and', chr(10), 'that is it; done')
         ELSE concat('SELECT AddGeometryColumn(', chr(39), 'part', chr(39), ', ', chr(39), 'p_name', chr(39), ', 4326), ST_EstimatedExtent(', chr(39), 'customer', chr(39), ', ', chr(39), 'geom', chr(39), ') FROM public.part ORDER BY p_name DESC, p_partkey LIMIT 3;') END AS pred_sql
FROM @orders
""",
)

# Benchmark items with schema text; ids repeat (ord tells which one is last).
view(
    "items",
    """
SELECT CASE WHEN o_orderkey % 5 = 4 THEN o_orderkey - 1 ELSE o_orderkey END AS new_id, o_orderkey AS ord,
       CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE concat('db', CAST(o_custkey % 3 AS STRING)) END AS db_id,
       CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 7 = 1 THEN '' ELSE concat('ST_', o_orderstatus) END AS function_name,
       CASE WHEN o_custkey % 4 = 0 THEN 'ST_Any' END AS function_alt,
       CASE WHEN o_custkey % 11 = 0 THEN '' ELSE concat(
         '# nation (n_nationkey integer, n_name varchar(25), n_regionkey integer) # region (r_regionkey integer, r_name text)',
         chr(10), '# customer (c_custkey bigint, c_name text, c_acctbal numeric(12,2), "geom" geometry(Point,4326))',
         ' # supplier (s_suppkey bigint, s_name text, s_nationkey integer) # part (p_partkey bigint, p_name text)',
         ' # t_', CAST(o_custkey AS STRING), ' (k_', CAST(o_custkey AS STRING), ' decimal(10,(2)), note text)') END AS schema
FROM @orders
""",
)

# Result tables: 50 rows and 3 columns per query. The prediction swaps columns, changes case,
# and has a wrong value, a missing row or no rows in some queries.
view(
    "grid",
    """
SELECT concat('q', CAST(CAST(floor(c_custkey / 50) AS BIGINT) AS STRING)) AS query_id,
       CAST(floor(c_custkey / 50) AS BIGINT) AS q, CAST(c_custkey % 50 AS INT) AS row_idx,
       c_custkey, c_name, c_nationkey, c_mktsegment
FROM @customer
""",
)
view(
    "cells",
    """
SELECT query_id, 'gold' AS side, row_idx, 0 AS col_idx, 'name' AS col_name, c_name AS value FROM $grid WHERE q % 11 <> 10
UNION ALL SELECT query_id, 'gold', row_idx, 1, 'nation', CAST(c_nationkey AS STRING) FROM $grid WHERE q % 11 <> 10
UNION ALL SELECT query_id, 'gold', row_idx, 2, 'segment', CASE WHEN row_idx % 9 = 0 THEN NULL ELSE c_mktsegment END FROM $grid WHERE q % 11 <> 10
UNION ALL SELECT query_id, 'pred', row_idx, 0, 'nation', concat(' ', CAST(c_nationkey AS STRING)) FROM $grid WHERE q % 7 <> 6 OR row_idx < 49
UNION ALL SELECT query_id, 'pred', row_idx, 1, 'name',
       CASE WHEN q % 3 = 1 AND row_idx = 7 THEN 'wrong' ELSE lower(c_name) END FROM $grid WHERE q % 7 <> 6 OR row_idx < 49
""",
)
# The same results, both sides in the same column order.
view(
    "placed",
    """
SELECT query_id, 'gold' AS side, row_idx, 0 AS col_idx, 'name' AS col_name, c_name AS value FROM $grid
UNION ALL SELECT query_id, 'gold', row_idx, 1, 'point', concat('POINT(', CAST(c_custkey AS STRING), ' ', CAST(c_nationkey AS STRING), ')') FROM $grid WHERE q % 6 <> 5
UNION ALL SELECT query_id, 'pred', row_idx, 0, 'name', CASE WHEN q % 3 = 1 AND row_idx = 7 THEN 'wrong' ELSE upper(c_name) END FROM $grid
UNION ALL SELECT query_id, 'pred', row_idx, 1, 'point',
       CASE WHEN q % 4 = 2 THEN concat('SRID=4326;point(', CAST(c_custkey AS STRING), '.0 ', CAST(c_nationkey AS STRING), '.000001)')
            WHEN q % 4 = 3 THEN concat('POINT Z (', CAST(c_custkey AS STRING), ' ', CAST(c_nationkey AS STRING), ' 5)')
            ELSE concat('Point (', CAST(c_custkey AS STRING), ' ', CAST(c_nationkey AS STRING), ')') END FROM $grid
""",
)

# Point cells on whole coordinates.
view(
    "geoms",
    """
SELECT c_custkey AS id, c_custkey AS x, c_nationkey AS y,
       concat('POINT(', CAST(c_custkey AS STRING), ' ', CAST(c_nationkey AS STRING), ')') AS expected,
       CASE c_custkey % 7
         WHEN 0 THEN concat('SRID=4326;POINT(', CAST(c_custkey AS STRING), ' ', CAST(c_nationkey AS STRING), ')')
         WHEN 1 THEN concat(' point (', CAST(c_custkey AS STRING), '.0 ', CAST(c_nationkey AS STRING), ')')
         WHEN 2 THEN concat('POINT Z (', CAST(c_custkey AS STRING), ' ', CAST(c_nationkey AS STRING), ' 5)')
         WHEN 3 THEN 'POINT EMPTY'
         WHEN 4 THEN concat('POINT(', CAST(c_custkey AS STRING), ' ', CAST(c_nationkey AS STRING), '.000001)')
         WHEN 5 THEN concat('01010000000000000000000840000000000000', '1040')
         ELSE concat('1234567890', CAST(100000000 + c_custkey AS STRING)) END AS actual
FROM @customer
""",
)
view(
    "shapes",
    """
SELECT c_custkey AS id,
       concat('LINESTRING(0 0,', CAST(c_custkey AS STRING), ' 1,', CAST(c_custkey AS STRING), ' ', CAST(c_nationkey + 2 AS STRING), ')') AS line_a,
       CASE c_custkey % 3
         WHEN 0 THEN concat('MULTILINESTRING((', CAST(c_custkey AS STRING), ' ', CAST(c_nationkey + 2 AS STRING), ', ', CAST(c_custkey AS STRING), ' 1, 0 0))')
         WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN concat('LINESTRING(0 0, ', CAST(c_custkey AS STRING), ' 1)') ELSE concat('LINESTRING(', CAST(c_custkey AS STRING), ' 1)') END
         ELSE concat('LINESTRING Z (0 0 1,', CAST(c_custkey AS STRING), ' 1 2,', CAST(c_custkey AS STRING), ' ', CAST(c_nationkey + 2 AS STRING), ' 3)') END AS line_b,
       concat('POLYGON((0 0,', CAST(c_custkey + 9 AS STRING), ' 0,', CAST(c_custkey + 9 AS STRING), ' 9,0 9,0 0),(1 1,2 1,2 2,1 1),(3 3,4 3,4 4,3 3))') AS area_a,
       CASE c_custkey % 3
         WHEN 0 THEN concat('POLYGON((', CAST(c_custkey + 9 AS STRING), ' 9,', CAST(c_custkey + 9 AS STRING), ' 0,0 0,0 9,', CAST(c_custkey + 9 AS STRING), ' 9),(4 4,3 3,4 3,4 4),(1 1,2 2,2 1,1 1))')
         WHEN 1 THEN concat('MULTIPOLYGON(((0 0,', CAST(c_custkey + 9 AS STRING), ' 0,', CAST(c_custkey + 9 AS STRING), ' 9,0 9,0 0),(1 1,2 1,2 2,1 1),(3 3,4 3,4 4,3 3)))')
         ELSE CASE c_custkey % 4 WHEN 0 THEN concat('POLYGON((0 0,', CAST(c_custkey + 9 AS STRING), ' 0,', CAST(c_custkey + 9 AS STRING), ' 9,0 9,0 0))')
           WHEN 1 THEN concat('POLYGON((0 0,', CAST(c_custkey + 9 AS STRING), ' 0,', CAST(c_custkey + 9 AS STRING), ' 9,0 9),(1 1,2 1,2 2,1 1),(3 3,4 3,4 4,3 3))')
           WHEN 2 THEN concat('GEOMETRYCOLLECTION(POLYGON((0 0,', CAST(c_custkey + 9 AS STRING), ' 0,0 0)))') ELSE 'GEOMETRYCOLLECTION(foo)' END END AS area_b
FROM @customer
""",
)

view(
    "errors",
    """
SELECT concat('m_', CAST(user_id % 4 AS STRING)) AS model, event_id AS id, CAST(event_id % 5 + 1 AS INT) AS round,
       CASE WHEN event_id % 2 = 0 THEN concat('k', CAST(event_id AS STRING)) ELSE '' END AS unique_key,
       CASE event_type WHEN 'error' THEN 'ERROR: syntax error at or near "FROM"'
         WHEN 'click' THEN concat('function st_foo(integer) does not exist: ', props)
         WHEN 'view' THEN concat('relation "t', CAST(user_id AS STRING), '" does not exist')
         WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'Operation on mixed SRID geometries'
                                 WHEN event_id % 3 = 1 THEN 'parse error - invalid geometry' ELSE 'could not connect to server' END
         ELSE CASE WHEN event_id % 4 = 0 THEN concat('Row count mismatch: pred ', CAST(user_id AS STRING), ' vs gold 1') ELSE ' ' END END AS execution_error,
       CASE event_id % 4 WHEN 0 THEN '`sql syntax errors`' WHEN 1 THEN concat('"Missing Objects"', chr(10), 'because')
         WHEN 2 THEN ' PostGIS Function Errors ' ELSE 'no idea' END AS response
FROM @events
""",
)
view(
    "model_names",
    """
SELECT DISTINCT concat('m_', CAST(user_id % 4 AS STRING)) AS model, CAST(user_id % 2 AS INT) AS category,
       concat('Model ', CAST(user_id % 4 AS STRING)) AS name,
       CASE WHEN user_id % 4 < 3 THEN CAST(9 - user_id % 4 AS INT) END AS name_ord
FROM @events WHERE user_id % 4 <> 1
""",
)

# Overloads (four per function) and calls with known argument types.
view(
    "signatures",
    """
SELECT concat('ST_F', CAST(CAST(floor(p_partkey / 4) AS BIGINT) AS STRING)) AS function_name, p_partkey AS sig_ord,
       CASE p_size % 5 WHEN 0 THEN 'geometry,integer' WHEN 1 THEN 'geometry,numeric,text' WHEN 2 THEN 'geometry'
         WHEN 3 THEN 'integer,integer,integer' ELSE 'text,integer' END AS types,
       p_size % 5 = 2 AS variadic
FROM @part
""",
)
view(
    "typed_calls",
    """
SELECT o_orderkey AS id, concat('m_', o_orderstatus) AS model,
       concat('st_f', CAST(CAST(floor(o_custkey / 3) AS BIGINT) AS STRING)) AS function_name,
       CASE o_orderkey % 6 WHEN 0 THEN 'geometry,integer' WHEN 1 THEN 'geometry,geometry,text'
         WHEN 2 THEN 'geometry,numeric,text' WHEN 3 THEN 'integer' WHEN 4 THEN 'text,text' ELSE 'geometry' END AS types
FROM @orders
""",
)
view(
    "shape_cuts",
    """
SELECT id, k, concat('LINESTRING(0 0,', 4 * k, ' 8)') AS line, concat('POLYGON((0 0,', 6 * k, ' 0,', 6 * k, ' 6,0 6,0 0))') AS area,
       CASE id % 4
         WHEN 0 THEN concat('MULTILINESTRING((', 4 * k, ' 8,', 2 * k, ' 4),(0 0,', 2 * k, ' 4))')
         WHEN 1 THEN concat('MULTILINESTRING((0 0,', 3 * k, ' 6),(', 4 * k, ' 8,', k, ' 2),(0 0,', 4 * k, ' 8))')
         WHEN 2 THEN concat('MULTILINESTRING((0 0,', k, ' 2),(', 2 * k, ' 4,', 4 * k, ' 8))')
         ELSE concat('LINESTRING(0 0,', k, ' 2,', 2 * k, ' 4,', 3 * k, ' 6,', 4 * k, ' 8)') END AS line_cut,
       CASE id % 4
         WHEN 0 THEN concat('POLYGON((0 0,', k, ' 0,', 2 * k, ' 0,', 6 * k, ' 0,', 6 * k, ' 1,', 6 * k, ' 6,0 6,0 3,0 0))')
         WHEN 1 THEN concat('MULTIPOLYGON(((0 0,', 2 * k, ' 0,', 2 * k, ' 6,0 6,0 0)),((', 2 * k, ' 0,', 6 * k, ' 0,', 6 * k, ' 6,', 2 * k, ' 6,', 2 * k, ' 0)))')
         WHEN 2 THEN concat('POLYGON((0 0,', k, ' 1,', 6 * k, ' 0,', 6 * k, ' 6,0 6,0 0))')
         ELSE concat('POLYGON((', 6 * k, ' 6,', 6 * k, ' 2,', 6 * k, ' 0,', k, ' 0,0 0,0 6,', 6 * k, ' 6))') END AS area_cut
FROM (SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey % 1000 + 1 AS BIGINT) AS k FROM @orders)
""",
)
view(
    "nested_geoms",
    """
SELECT id, n, whole, concat(repeat('GeometryCollection (', n), 'LINESTRING Z (0 0 1, 1 ', id, ' 2), ', repeat('GEOMETRYCOLLECTION(POINT(1 2)),', n), 'POINT(',
         id, ' ', n, ')', repeat(' )', CASE WHEN whole THEN n ELSE n - 1 END)) AS shape
FROM (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_nationkey * 2 + 1 AS INT) AS n, c_custkey % 5 <> 0 AS whole FROM @customer)
""",
)
