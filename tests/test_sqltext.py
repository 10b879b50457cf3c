"""References, calls, argument types, errors and files on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from scoreframe import sources as IO
from scoreframe.functions import sqltext as S
from scoreframe.operators import calls as K
from scoreframe.operators import enrich
from scoreframe.operators import errors as X
from scoreframe.operators import refs as R
from scoreframe.sources import SCHEMAS

SCHEMA = """# Roads (id int, "name" varchar(10), shape geometry(LineString, 4326), note text) text
#towns(gid integer, name text)
# broken (a int, b (c
# Roads (again int)"""


def picked(spark, sql, schema=SCHEMA):
    df = R.parse_schema(spark.createDataFrame([(sql, schema)], "pred_sql STRING, schema STRING"))
    return [(t["table"], list(t["columns"])) for t in R.pick_refs(df).first()["tables"]]


def test_parse_schema(spark):
    df = R.parse_schema(spark.createDataFrame([(SCHEMA,), ("",), (None,)], "schema STRING"))
    got = [[(t["table"], list(t["columns"])) for t in r["catalog"]] for r in df.collect()]
    assert got == [[("Roads", ["id", "name", "shape", "note"]), ("towns", ["gid", "name"])], [], []]
    deep = "# a (x numeric((((1)))), # b (q int), y int) # c (z decimal(10,(2)), w int)"
    flat = "# a (x numeric(1), # b (q int), y int) # c (z decimal(10,(2)), w int) # a (v int)"
    for text in (deep, flat):
        row = R.parse_schema(spark.createDataFrame([(text,)], "schema STRING")).first()
        assert [(t["table"], list(t["columns"])) for t in row["catalog"]] == [("a", ["x", "y"]), ("c", ["z", "w"])]


def test_pick_refs(spark):
    assert picked(spark, "SELECT r.name, gid FROM Roads AS r JOIN public.towns t ON r.id = t.gid") == [
        ("Roads", ["name", "id"]), ("towns", ["gid"]),
    ]
    # A bare name two tables share is nobody's; unknown tables vanish, known ones stay.
    assert picked(spark, "SELECT name FROM Roads r JOIN towns t ON true JOIN mars m ON true") == [("Roads", []), ("towns", [])]
    # Without an alias the word JOIN is taken for one, and the table behind it is not seen.
    assert picked(spark, "SELECT name FROM Roads JOIN towns ON true") == [("Roads", ["name"])]
    # Quoted text and comments hold no names.
    assert picked(spark, "SELECT note /* shape */ FROM Roads -- id\n WHERE 'name it''s' = note") == [("Roads", ["note"])]
    # Functions are no columns; what follows FROM in EXTRACT is taken for a table.
    assert picked(spark, "SELECT extract(year FROM note), shape(1) FROM Roads") == [("Roads", [])]
    assert picked(spark, "SELECT DropGeometryColumn('Roads', 'shape'), f(')', find_srid('public'::text, 'towns', 'name'))") == [
        ("Roads", ["shape"]), ("towns", ["name"]),
    ]
    assert picked(spark, "SELECT AddGeometryColumn('public', 'Roads', 'shape'") == []
    assert picked(spark, "") == [] and picked(spark, None) == []


def test_hit_rates_skip_or_count_missing(spark):
    refs = "ARRAY<STRUCT<table: STRING, columns: ARRAY<STRING>>>"
    pred = spark.createDataFrame(
        [("m", 1, [("T", ["a", "x"])]), ("m", 2, [("t", [])])], f"model STRING, id INT, tables {refs}"
    )
    gold = spark.createDataFrame(
        [(1, [('"t"', ["A", "b"]), ("u", ["c"])]), (2, [("t", ["a"])]), (3, [("v", ["z"])])], f"id INT, tables {refs}"
    )
    row = R.hit_rates(pred, gold).first()
    assert (row["matched_items"], row["table_hit_count"], row["table_total_count"]) == (1, 1, 2)
    assert (row["column_hit_count"], row["column_total_count"]) == (1, 3)
    strict = R.hit_rates(pred, gold, strict=True).first()
    assert (strict["matched_items"], strict["table_total_count"]) == (2, 3)


def test_calls_nest_and_quote(spark):
    deep = "ST_X(" * 30 + "1" + ")" * 30
    df = spark.createDataFrame(
        [(1, "SELECT f(a, g(b, ')', (c)), 'it''s, (') , F ( )"), (2, f"SELECT f({deep}, 2)"), (3, "SELECT f(1")],
        "id INT, pred_sql STRING",
    ).withColumn("fn", F.lit("F"))
    got = {(r["id"], r["call_idx"]): list(r["args"]) for r in K.calls(df, ["id"], "fn").collect()}
    assert got == {(1, 0): ["a", "g(b, ')', (c))", "'it''s, ('"], (1, 1): [], (2, 0): [deep, "2"]}


def test_argument_types(spark):
    args = ["1", "3000000000", "1.5", "-2e3", "TRUE", "'x'", "null", "a.b", "x::varchar(3)", "CAST(a AS double precision)",
            "g(1)", "h(2)", "'2020'::date", "1::int"]
    df = spark.createDataFrame([(1, args)], "id INT, args ARRAY<STRING>")
    returns = spark.createDataFrame([("G", "geometry")], "function_name STRING, return_type STRING")
    got = K.arg_types(df, ["id"], returns).first()["actual_arg_types"]
    # Of several return types the least counts, and rows that repeat their keys stay.
    more = returns.unionByName(spark.createDataFrame([("g", "text"), ("G", "geometry")], returns.schema))
    twice = K.arg_types(df.unionByName(df), ["id"], more).collect()
    assert [r["actual_arg_types"] for r in twice] == [got, got]
    bad = K.UNKNOWN_TYPE
    assert got == ["integer", "bigint", "numeric", "numeric", "boolean", "unknown", "unknown", bad, "character varying",
                   "double precision", "geometry", bad, "date", "integer"]


def test_best_signature(spark):
    sigs = spark.createDataFrame(
        [("F", ["int", "text"], False, 0), ("f", ["int", "date"], False, 1), ("f", ["int"], True, 2), ("z", [], False, 3)],
        "function_name STRING, input_types ARRAY<STRING>, variadic BOOLEAN, sig_ord INT",
    )
    calls = spark.createDataFrame(
        [(1, "f", ["int", "date"]), (2, "f", ["int", "x", "int"]), (3, "f", ["x"]), (4, "Z", []), (5, "f", ["int", "q"]), (6, "f", None)],
        "id INT, function_name STRING, actual_arg_types ARRAY<STRING>",
    )
    got = {r["id"]: r for r in K.best_signature(calls, sigs, ["id"]).collect()}
    assert [got[i]["param_type_match_ratio"] for i in range(1, 7)] == [1.0, 0.6667, 0.0, 1.0, 0.5, 0.0]
    assert got[1]["expected_arg_types"] == ["int", "date"]
    assert got[2]["param_type_match_detail"] == ["✔ int", "✘ x ≠ int", "✔ int"]
    assert got[5]["expected_arg_types"] == ["int", "text"]  # the first listed wins a tie
    assert got[3]["param_type_match_detail"] == []


def test_structure(spark):
    texts = ["SELECT 1", "SELECT (1", "SELECT 'a", "hello", "SELECT 1 FROM", "(SELECT 1)", "SELECT ')' ;", "SELECT )("]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, pred_sql STRING")
    got = [r["structure_valid"] for r in K.with_calls(df).orderBy("i").collect()]
    assert got == [True, False, False, False, False, True, True, False]


def test_error_classes_and_pivot_without_errors(spark):
    messages = {
        'syntax error at or near "x"': "SQL Syntax Errors",
        "function st_x(text) does not exist": "PostGIS Function Errors",
        'column "a" does not exist': "Missing Objects",
        "missing FROM-clause entry for table": "Missing Objects",
        "cannot mix dimensionality in a geometry": "Geometry Parsing Errors",
        "Coordinate dimension mismatch": "SRID/Dimension Mismatch",
        "expected 1 row, got 3 rows": "Result Mismatch Errors",
        "permission denied": "Environment/Connection Errors",
        "  ": None,
    }
    df = spark.createDataFrame([("m", k) for k in messages], "model STRING, execution_error STRING")
    got = {r["execution_error"]: r["error_type"] for r in X.classify_errors(df).collect()}
    assert got == messages
    names = spark.createDataFrame([("m", 1, "M", 0), ("n", 2, "N", None)], "model STRING, category INT, name STRING, name_ord INT")
    counts = X.error_counts(X.classify_errors(df))
    rows = X.error_pivot(counts, names, rows="model").collect()
    assert [r["name"] for r in rows] == ["M", "N"] and sum(rows[1][2:]) == 0 and sum(rows[0][2:]) == 8
    assert X.error_pivot(counts, names, heads=["M", "N"]).columns == ["error_type", "M", "N"]


# --- files -----------------------------------------------------------------------------------


def lines(tmp_path, *texts, name="predictions.jsonl"):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(texts) + "\n", encoding="utf-8")
    return str(path)


GOOD = json.dumps({"id": 1, "round": 2, "pred_sql": "é", "expected_result": [[1]], "other": 1}, ensure_ascii=False)


def test_scan_modes(spark, tmp_path):
    path = lines(tmp_path, GOOD, "", "   ", '{"id": 2, ', GOOD)
    schema = SCHEMAS["sql_predictions"]
    with pytest.raises(Exception, match="(?i)malformed"):
        IO.read_predictions(spark, path, schema).collect()
    assert IO.read_predictions(spark, path, schema, "DROPMALFORMED").count() == 2
    good, bad = IO.read_with_rejects(spark, path, schema)
    row = good.first()
    assert (row["id"], row["round"], row["pred_sql"], row["model"]) == ("1", 2, "é", None)
    assert [r["line"] for r in bad.collect()] == ['{"id": 2, ']


def test_byte_order_mark(spark, tmp_path):
    path = lines(tmp_path, "﻿" + GOOD, "﻿" + GOOD)
    assert [r["id"] for r in IO.read_predictions(spark, path, "id STRING", bom=True).collect()] == ["1", "1"]
    bad = lines(tmp_path, "﻿" + GOOD, "oops", name="bad.jsonl")
    with pytest.raises(Exception, match="malformed line: oops"):
        IO.read_predictions(spark, bad, "id STRING", bom=True).collect()


def test_model_directories(spark, tmp_path):
    for m in ("gpt x", "b"):
        lines(tmp_path / "base", '{"id": 1, "model": "other"}', name=f"{m}/p.jsonl")
        lines(tmp_path / "base", '{"n": 1}' if m == "b" else "[1]", name=f"{m}/s.json")
    (tmp_path / "base" / "empty").mkdir()
    runs = IO.read_runs(spark, str(tmp_path / "base"), "p.jsonl", "id STRING, model STRING")
    assert sorted(r["model"] for r in runs.collect()) == ["b", "gpt x"]
    found = {r["model"]: r["parse_error"] for r in IO.read_summaries(spark, str(tmp_path / "base"), "s.json").collect()}
    assert found == {"b": None, "gpt x": "summary is not a JSON object"}


def test_file_order_over_many_splits(spark, tmp_path):
    path = lines(tmp_path, *[json.dumps({"n": i, "pad": "x" * 50}) for i in range(20_000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        df = IO.with_ingest_order(spark.read.schema("n INT").json(path))
        assert df.rdd.getNumPartitions() > 8
        assert [r["n"] for r in df.orderBy("ord").collect()] == list(range(20_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_signature_file(spark, tmp_path):
    (tmp_path / "s.json").write_text(
        json.dumps([{"function_name": "f", "input_types": ["a"], "variadic": "True"},
                    {"function_name": "g", "input_types": [], "variadic": False}, {"function_name": "h"}], indent=1)
    )
    got = [tuple(r) for r in IO.read_signatures(spark, str(tmp_path / "s.json")).orderBy("sig_ord").collect()]
    assert got == [("f", ["a"], True, 0), ("g", [], False, 1), ("h", None, False, 2)]


def test_comments_and_quotes_hide_what_they_hold(spark):
    good = [
        "SELECT ST_Area(geom) -- it's the area\nFROM t", "SELECT ST_Area(g) -- (x\nFROM t", 'SELECT ST_Area("a(b") FROM t', "SELECT ST_Area($$it's (,$$, 2)",
        "SELECT ST_Area('--', '/*', g)", "/* don't ( */ SELECT ST_Area(x)", "SELECT ST_Area($f$ $$ ' $f$)", 'SELECT "it\'s", ST_Area(a) FROM t',
        "SELECT '''(', ST_Area(1)",
    ]
    bad = [
        "SELECT FROM WHERE x y z", "SELECT ST_Area('a)", 'SELECT ST_Area("a)', "SELECT ST_Area(a", "SELECT ST_Area(1) /* open", "SELECT ST_Area($$a)",
        "SELECT ST_Area(1) FROM", "SELECT ST_Area(1)) -- (",
    ]
    df = spark.createDataFrame([(t, t in good) for t in good + bad], "pred_sql STRING, ok BOOLEAN")
    df = df.withColumn("function_name_used", F.lit("ST_Area"))
    got = K.first_call(df).collect()
    assert [(r.pred_sql, r.function_hit) for r in got] == [(r.pred_sql, r.ok) for r in got]
    args = {r.pred_sql: r.args for r in got if r.ok}
    assert args[good[2]] == ['"a(b"'] and args[good[3]] == ["$$it's (,$$", "2"] and args[good[4]] == ["'--'", "'/*'", "g"]


def test_clause_shapes(spark):
    df = spark.createDataFrame([("SELECT \"where\" FROM \"from\" WHERE a = 'from where'",)], "pred_sql STRING")
    assert K.with_calls(df).first().structure_valid


def test_cost_of_parentheses_is_near_linear(spark):
    """Ten times the calls in one text cost about ten times the time."""
    import time

    def took(n):
        sql = "SELECT " + ", ".join(f"f(g({k}), 'x(')" for k in range(n)) + " FROM t"
        df = spark.createDataFrame([(sql, "f")], "pred_sql STRING, target STRING").coalesce(1)
        best = []
        for _ in range(3):
            start = time.perf_counter()
            got = K.with_calls(df, name="c", target="target").select(F.size("c"), F.col("c")[n - 1]["args"][0], "structure_valid").first()
            best.append(time.perf_counter() - start)
            assert tuple(got) == (n, f"g({n - 1})", True)
        return min(best)

    took(20)
    small, large = took(400), took(4000)
    assert large < 25 * small + 1


def test_both_schema_readers_agree(spark):
    import random

    from scoreframe.functions import sqltext as S

    r = random.Random(4)
    bits = ["# ", "#", "roads", "towns ", " id int", ", ", "name text", "(", ")", " (", ") ", "numeric(10,2)", "geom geometry(Point, 4326)", '"q" int', "\n", "x"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 24))) for _ in range(3000)]
    texts += [f"# a{k} (id int, g geometry(Point, {k}), n numeric(1,(2))) # b (x int)" for k in range(20)]
    column = lambda: r.choice(["id int", '"q" int', " n numeric(10,2)", "g geometry(Point, 4326)", "m numeric(1,(2))", "", "# x (y int)"])
    for _ in range(500):
        tables = [f"{r.choice(['# ', '#', '', 'x # '])}{r.choice(['a', 'b', 'c_1'])}{r.choice(['', ' '])}({', '.join(column() for _ in range(r.randint(0, 4)))})" for _ in range(3)]
        texts.append(r.choice([" ", "\n", " (z) "]).join(tables))
    plain, shallow, deep = S._schema_readers("t")
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").where(F.expr(plain))
    both = df.select("t", F.expr(shallow).alias("a"), F.expr(deep).alias("b")).cache()
    wrong = both.where("a != b").take(5)
    assert not wrong and both.where("size(a) > 0").count() > 100


def test_references_clean_a_text_once():
    """The columns with and without an owner are read from one cleaned text."""
    from scoreframe.functions import sqltext as S

    assert R._hits("x").count(S._sanitized("x")) == 1


def test_texts_are_read_by_all_cores(spark):
    from scoreframe.catalog import load_all
    from tests.oracle import DATA

    for name in ("expression_types", "match_geometry_columns"):
        df = load_all()[name].run(spark, f"{DATA}/sf0.001")
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().toString(), name


def test_a_text_is_searched_once_per_pattern(spark):
    """One pass finds FROM items and one finds owner.column pairs; management calls are looked for only where one is named."""
    for made in (S.from_items("t"), S.owner_pairs("t", clean=True)):
        assert made.count("regexp_extract_all") == 1
    text = "select n.a, b, \"n\" . c, z from s.nation as n join t2 -- b\nwhere c = 'x.y'"
    # A table that the catalog lists twice is one owner.
    cat = "array(named_struct('table', 'nation', 'columns', array('a', 'b')), named_struct('table', 'nation', 'columns', array('b', 'c')), named_struct('table', 't2', 'columns', array('z', 'x')))"
    df = spark.createDataFrame([(text,), ("find_srid('public', 'nation', 'b')",), ("no statement",)], "pred_sql string").withColumn("catalog", F.expr(cat))
    got = [[(t["table"], t["columns"]) for t in r["tables"]] for r in R.pick_refs(df).collect()]
    assert got == [[("nation", ["a", "c", "b"]), ("t2", ["z"])], [("nation", ["b"])], []]
    found = df.select(S.from_tables("pred_sql").alias("f")).first()["f"]
    assert [tuple(x) for x in found] == [("s.nation", "nation", "n"), ("t2", "t2", None)]


def test_equal_schema_texts_are_parsed_once(spark, monkeypatch):
    """Items that share a schema text share its catalog; the last item of an id counts."""
    parsed = []
    monkeypatch.setattr(enrich, "parse_schema", lambda df: parsed.append(df) or R.parse_schema(df))
    shared, own = "# a (x int, y text)", "# b (z int)"
    rows = [(k, k, shared) for k in range(50)] + [(3, 60, own), (4, 61, ""), (5, 62, None), (None, 63, own), (70, 1, "no table")]
    items = spark.createDataFrame(rows, "new_id long, ord long, schema string")
    preds = spark.createDataFrame([(k, "SELECT x FROM a") for k in [*range(51), 70]] + [(1, None), (None, "SELECT 1")], "id long, pred_sql string")
    got = {r.id: r for r in enrich.attach_schema(preds, items, parse=True).collect()}
    assert sorted(got) == [*range(51), 70] and got[50].schema_error and got[50].catalog is None
    assert all((got[k].schema_error is None) for k in [*range(50), 70]) and got[70].catalog == []
    assert {tuple(t.table for t in got[k].catalog) for k in range(50) if k != 3} == {("a",)}
    assert [(t.table, t.columns) for t in got[3].catalog] == [("b", ["z"])]
    assert parsed[0].count() == 3


def test_readers_of_management_calls_agree(spark):
    """Where no call has parentheses between its own, one expression reads what the reader by pieces reads."""
    import random

    r = random.Random(7)
    bits = ["find_srid(", "AddGeometryColumn (", "xfind_srid(", "st_estimatedextent\n(", "(", ")", ")", ") ", "'a'", ", ", ",", " ", "'b,c'", "x", "4326", "f(1)", "", "　"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    plain, flat, deep = R._call_readers("t")
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").where(F.expr(plain))
    both = df.select("t", F.expr(flat).alias("a"), F.expr(deep).alias("b")).cache()
    assert not both.where("a != b").take(5) and both.where("size(a) > 0").count() > 100


def test_reading_references_is_dealt_over_all_cores(spark):
    """Schema texts and predictions are dealt among more tasks than cores, and no small shuffle is put together again."""
    items = spark.createDataFrame([(k, k, f"# t{k} (x int)") for k in range(20)], "new_id long, ord long, schema string")
    preds = spark.createDataFrame([(k, f"SELECT x FROM t{k}") for k in range(20)], "id long, pred_sql string")
    made = enrich.attach_schema(preds, items, parse=True)
    assert made._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("REPARTITION_BY_NUM") >= 2
    got = {r.id: [(t["table"], t["columns"]) for t in r["tables"]] for r in R.pick_refs(made).collect()}
    assert got == {k: [(f"t{k}", ["x"])] for k in range(20)}


def test_columns_are_looked_up_without_array_contains(spark):
    """Columns are pairs with their table; null names, null texts and blanks around a dot stay what they are."""
    assert "array_contains" not in R._hits("x")
    cat = "array(named_struct('table', 'a', 'columns', array('x', CAST(NULL AS STRING), 'select')), named_struct('table', CAST(NULL AS STRING), 'columns', array('x', 'y')), named_struct('table', 'b', 'columns', CAST(NULL AS ARRAY<STRING>)))"
    rows = [("select \"a\" \t.\n\x0b\"x\", x, y, select from s.a join b",), ("select x from b",), (None,)]
    df = spark.createDataFrame(rows, "pred_sql string").withColumn("catalog", F.expr(cat))
    assert [[tuple(h) for h in r["hits"]] for r in R.resolve_columns(df).collect()] == [[("a", "x")], [], []]
    assert [r["q"] and [tuple(x) for x in r["q"]] for r in df.select(S.qualified_columns("pred_sql").alias("q")).collect()] == [[("a", "x"), ("s", "a")], [], None]
