"""Types of expressions read from their text, and growth of the call reader."""

import random
import time

import pytest
from pyspark.sql import functions as F

from scoreframe.functions import sqltext as S
from scoreframe.operators import calls as K

RETURNS = [
    ("ST_Buffer", "geometry", None), ("st_point", "geometry", None), ("ST_MakePoint", "geometry", None), ("st_setsrid", "geometry", None),
    ("f", "text", ["integer"]), ("f", "integer", ["text"]), ("f", "bigint", ["integer", "text"]), ("ST_X", "double precision", None),
    ("ST_DWithin", "boolean", None), ("count", "bigint", None), ("now", "timestamp with time zone", []),
]
# None: no type.
CASES = {
    "1 + 2.5": "numeric", "a || 'x'": None, "'a' || 'x'": "text", "ST_Buffer(ST_Point(1,2), 3)": "geometry", "1": "integer", "3000000000": "bigint",
    "99999999999999999999": "numeric", "-5": "integer", "1/2": "integer", "(1+2)*3": "integer", "2^3": "double precision", "2.0^3": "numeric",
    "1 < 2": "boolean", "NOT true": "boolean", "1 <> 2 AND 'a' = 'b'": "boolean", "x": None, "a.b": None, '"Col"': None, "x::int": "integer",
    "1 + x::int": "integer", "1.5::float8 * 2": "double precision", "'1'::real + 1::real": "real", "'1'::real + 1": "double precision",
    "'2020-01-01'::date - '2019-01-01'::date": "integer", "DATE '2020-01-01' + INTERVAL '1 day'": "timestamp without time zone",
    "date '2020-01-01' + 1": "date", "now() - interval '1 hour'": "timestamp with time zone", "interval '1 day' * 2": "interval",
    "CAST('1' AS double precision) + 1": "double precision", "CAST('a' AS varchar(5))": "character varying", "ARRAY[1,2,3]": "integer[]",
    "ARRAY[ST_Point(1,2), ST_Point(3,4)]": "geometry[]", "ARRAY[x]": None, "'{1,2}'::int[]": "integer[]", "CASE WHEN 1=1 THEN 1 ELSE 2.5 END": "numeric",
    "CASE WHEN x THEN 'a' ELSE 'b' END": "text", "coalesce(1, 2.0)": "numeric", "(SELECT 1)": None, "geom <-> ST_Point(1,2)": None,
    "ST_Point(1,2) <-> ST_Point(1,1)": "double precision", "ST_Point(1,2) && ST_Point(3,4)": "boolean", "f(1)": "text", "f('x'::text)": "integer",
    "f(1, 'a'::text)": "bigint", "f(g(1),2)": "bigint", "g(1)": None, "1 IN (1,2)": "boolean", "'a' LIKE 'b%'": "boolean", "null": "unknown",
    "ST_SetSRID(ST_MakePoint(-71.1, 42.3), 4326)::geography": "geography", "E'a\\nb'": "unknown", "1e3": "numeric", "'POINT(1 2)'::geometry": "geometry",
    "geometry 'POINT(1 2)'": "geometry", "ST_X(ST_Point(1,2)) + 1": "double precision", "ST_DWithin(geom, ST_Point(1,2), 100) AND true": "boolean",
    "x + 1": None, "((((1))))": "integer", "count(*)": "bigint", "'(' || ')'": "text", "(1, 2)": "record", "now()::date": "date",
    "ST_Buffer( -- c (\n ST_Point(1,2), 2*(3+4))": "geometry", "'1'::timestamp with time zone": "timestamp with time zone", "": None,
    "1 +": "integer", "((": None, "'open": None, "/* c */ 1": "integer", "'a' -> 'b'": "unknown", "'{}'::jsonb -> 'b'": "jsonb", "'{}'::jsonb ->> 'b'": "text",
}


@pytest.fixture(scope="module")
def returns(spark):
    return spark.createDataFrame(RETURNS, "function_name STRING, return_type STRING, input_types ARRAY<STRING>")


def types(df):
    return [[None if t.startswith("ERROR") else t for t in r.actual_arg_types] if r.actual_arg_types is not None else None for r in df.collect()]


def test_expressions(spark, returns):
    df = spark.createDataFrame([(i, [a]) for i, a in enumerate(CASES)], "i INT, args ARRAY<STRING>")
    got = types(K.arg_types(df, ["i"], returns).orderBy("i"))
    assert {a: g for a, (g,) in zip(CASES, got) if g != CASES[a]} == {}


def test_rows_stay_as_they_are(spark, returns):
    rows = [(1, ["f(1)", "f(f(1))"], "a"), (1, ["f(1)", "f(f(1))"], "a"), (2, None, "b"), (3, [], None), (None, ["1", None], "c")]
    df = spark.createDataFrame(rows, "i INT, args ARRAY<STRING>, _x STRING")
    typed = K.arg_types(df, ["i"], returns)
    assert typed.columns == [*df.columns, "actual_arg_types"]
    got = sorted((r.i is None, r.i or 0, r._x or "", r.actual_arg_types) for r in typed.collect() if r.i != 2)
    assert [g[3][:1] for g in got] == [["text"], ["text"], [], ["integer"]]
    assert K.arg_types(df.where("i = 2"), ["i"], returns).first().actual_arg_types is None
    assert types(K.arg_types(df.where("i = 1"), ["i"])) == [[None, None]] * 2


def test_calls_are_parsed_once(spark, returns):
    df = spark.createDataFrame([(1, "SELECT f(f(1), 2)", "f")], "i INT, pred_sql STRING, function_name_used STRING")
    plan = K.arg_types(K.first_call(df), ["i"], returns)._jdf.queryExecution().optimizedPlan().toString()
    # The call reader's sort of the parentheses appears in one place of the plan.
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2


def brute_groups(text):
    """(start, stop) of the closed groups by a stack, in pieces cut before every parenthesis. A group that
    starts the text has nothing in front of it, so it is no call."""
    pieces = [""]
    for c in text:
        if c in "()":
            pieces.append("")
        pieces[-1] += c
    pieces = pieces[1:] if len(pieces) > 1 and not pieces[0] else pieces
    stack, out = [], []
    for k, p in enumerate(pieces):
        if p.startswith("("):
            stack.append(k)
        elif p.startswith(")") and stack:
            out.append((stack.pop(), k))
    return sorted(g for g in out if g[0])


def test_groups_against_a_stack(spark):
    r = random.Random(7)
    texts = ["".join(r.choice("((()))ab, ") for _ in range(r.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING").withColumn("ps", S.paren_pieces("t", masked=False))
    got = df.withColumn("g", F.expr(S.closed_groups("ps", "()"))).orderBy("i").collect()
    assert [[(g.start, g.stop) for g in r.g] for r in got] == [brute_groups(t) for t in texts]


def test_ten_times_the_calls_take_ten_times_as_long(spark):
    def seconds(n):
        sql = "SELECT " + ", ".join(f"f(a{k}, g({k}, (1)))" for k in range(n))
        df = spark.createDataFrame([(1, sql, "f")], "i INT, pred_sql STRING, function_name_used STRING").repartition(1)
        start = time.perf_counter()
        assert K.calls(df, ["i"], "function_name_used").count() == n
        return time.perf_counter() - start

    seconds(50)
    few, many = min(seconds(1000) for _ in range(3)), seconds(10_000)
    assert many < 10 * few + 2
