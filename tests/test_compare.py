"""Result comparison, geometry and matching on literal cells."""

import itertools
import random
import struct

import pytest
from pyspark.sql import functions as F

from scoreframe.functions import geometry as G
from scoreframe.operators import cells as C
from scoreframe.operators.pairs import run_pairs
from scoreframe.plans import score_expected, score_matched


def cells(spark, queries):
    """queries: {id: (gold rows, pred rows)}."""
    out = [
        (q, side, i, j, f"c{j}", v)
        for q, (gold, pred) in queries.items()
        for side, table in (("gold", gold), ("pred", pred))
        for i, row in enumerate(table)
        for j, v in enumerate(row)
    ]
    return spark.createDataFrame(
        out, "query_id STRING, side STRING, row_idx INT, col_idx INT, col_name STRING, value STRING"
    )


def verdicts(df):
    return {r["query_id"]: r["result_correct"] for r in df.collect()}


def equal(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i INT, a STRING, b STRING")
    df = df.withColumns({"x": G.decode_geom("a"), "y": G.decode_geom("b")})
    rows = df.select(
        "i", G.ewkt_equal("x", "y").alias("t"), G.geom_equal("x", "y").alias("s"),
        G.z_equal(G.z_values("x"), G.z_values("y")).alias("z"),
    ).collect()
    return [(r["t"], r["s"], r["z"]) for r in sorted(rows)]


def wkb_point(x, y, z=None, srid=None):
    code = 1 | (0x80000000 if z is not None else 0) | (0x20000000 if srid else 0)
    body = struct.pack("<BI", 1, code) + (struct.pack("<I", srid) if srid else b"")
    return (body + struct.pack("<" + "d" * (2 + (z is not None)), *[v for v in (x, y, z) if v is not None])).hex()


def test_geometry_pairs(spark):
    line = struct.pack("<BIIdddd", 1, 2, 2, 0.0, 0.0, 1.0, 2.0).hex().upper()
    got = equal(
        spark,
        [
            ("POINT(1 2)", "SRID=4326;point ( 1.0  2 )"),
            ("POINT(1 2)", wkb_point(1, 2, srid=4326)),
            ("POINT Z (1 2 3)", wkb_point(1, 2, 3)),
            ("POINT(1 2 3)", "POINT Z (1 2 3.0000001)"),
            ("POINT(1 2)", "POINT(1.000001 2)"),
            ("POINT(1 2)", "POINT(1.1 2)"),
            ("LINESTRING(0 0,1 2)", line),
            ("LINESTRING(0 0,1 2)", "LINESTRING(1 2,0 0)"),
            ("MULTIPOINT(1 2,3 4)", "MULTIPOINT((3 4),(1 2))"),
            ("MULTIPOINT(1 2,3 4)", "MULTIPOINT((1 2),(3 4))"),
            ("POLYGON((0 0,4 0,4 4,0 4,0 0))", "POLYGON((4 4,4 0,0 0,0 4,4 4))"),
            ("GEOMETRYCOLLECTION(POINT(1 2),LINESTRING(0 0,1 1))", "GEOMETRYCOLLECTION(LINESTRING(1 1,0 0),POINT(1 2))"),
            ("MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))", "MULTIPOLYGON(((5 5,6 5,6 6,5 5)),((1 1,0 0,1 0,1 1)))"),
            ("POINT(1 2)", "not a point"),
            ("POINT(1 2)", "1234567890123456"),
        ],
    )
    yes, no = True, False
    assert got == [
        (yes, yes, yes), (yes, yes, yes), (yes, yes, yes), (no, yes, yes), (no, yes, yes), (no, no, yes),
        (yes, yes, yes), (no, yes, yes), (no, yes, yes), (yes, yes, yes), (no, yes, yes), (no, yes, yes),
        (no, yes, yes), (no, no, no), (no, no, no),
    ]


def test_number_of_points_must_agree_for_z(spark):
    got = equal(spark, [("LINESTRING Z (0 0 5,1 1 5)", "LINESTRING Z (0 0 5,1 1 5,2 2 5)")])
    assert got == [(False, False, False)]


def test_positional_score(spark):
    got = score_expected(
        cells(
            spark,
            {
                "same": ([["A ", "1"]], [["a", "1"]]),
                "missing expected cell": ([["x"]], [["x", ""]]),
                "extra value": ([["x"]], [["x", "y"]]),
                "rows": ([["x"], ["y"]], [["x"]]),
                "no rows": ([["x"]], []),
                "null": ([[None]], [[None]]),
                "z": ([["POINT Z (1 2 3)"]], [["POINT Z (1 2 4)"]]),
                "mixed": ([["POINT(1 2)"], ["POINT(3 4)"]], [["POINT(1 2)"], ["oops"]]),
            },
        )
    )
    assert verdicts(got) == {
        "same": "correct", "missing expected cell": "correct", "extra value": "incorrect",
        "rows": "incorrect", "no rows": "unknown", "null": "correct", "z": "incorrect", "mixed": "incorrect",
    }


def test_matched_score(spark):
    got = score_matched(
        cells(
            spark,
            {
                "swapped": ([["a", "b"], ["c", "d"]], [["B", "A"], ["D", "C"]]),
                "subset": ([["a", "b"]], [["b"]]),
                "needs two": ([["a", "b"]], [["a", "a"]]),
                "two there": ([["a", "a"]], [["a", "a"]]),
                "row order": ([["a"], ["b"]], [["b"], ["a"]]),
                "rows": ([["a"]], [["a"], ["a"]]),
                "geometry": ([["POINT(1 2)", "x"]], [["x", "point(1.0 2.0)"]]),
                "shifted z": ([["POINT Z (1 2 3)"]], [["POINT Z (1 2 3.5)"]]),
                "no pred": ([["a"]], []),
            },
        )
    )
    assert verdicts(got) == {
        "swapped": "correct", "subset": "correct", "needs two": "incorrect", "two there": "correct",
        "row order": "incorrect", "rows": "incorrect", "geometry": "correct", "shifted z": "incorrect",
        "no pred": "incorrect",
    }


def test_failed_gold_query_is_unknown(spark):
    df = cells(spark, {"q": ([["a"]], [["b"]])})
    ok = spark.createDataFrame([("q", False)], "query_id STRING, gold_executable BOOLEAN")
    assert verdicts(score_matched(df, queries=ok)) == {"q": "unknown"}


def test_no_query_is_lost(spark):
    df = cells(spark, {"half": ([["a", "x"]], [["a", "y"]]), "good": ([["a"]], [["a"]]), "failed": ([], [["a"]])})
    listed = spark.createDataFrame(
        [("half", True, True, "s", "g", "d"), ("good", True, True, "s", "g", "d"), ("failed", False, True, "s", "g", "d"),
         ("gold failed", True, False, "s", "g", "d"), ("both empty", True, True, "s", "g", "d"), ("no sql", True, True, "", "g", "d"),
         ("no db", None, None, "s", "g", None)],
        "query_id STRING, executable BOOLEAN, gold_executable BOOLEAN, pred_sql STRING, gold_sql STRING, db_id STRING",
    )
    got = {r.query_id: r for r in score_matched(df, queries=listed).collect()}
    assert {k: r.result_correct for k, r in got.items()} == {
        "half": "incorrect", "good": "correct", "failed": "unknown", "gold failed": "unknown", "both empty": "unknown",
        "no sql": "error", "no db": "error",
    }
    assert got["half"].result_comparison == [] and got["half"].strategy_pass_rate.value_match == 0
    assert "unmatched" in got["half"].execution_error
    assert got["good"].result_comparison[0].pred_col == 0 and got["good"].strategy_pass_rate.value_match == 1
    assert not got["no sql"].executable and got["no sql"].execution_error.startswith("missing")
    expected = {r.query_id: r.result_correct for r in score_expected(df, queries=listed).collect()}
    assert expected == {
        "half": "incorrect", "good": "correct", "failed": "unknown", "gold failed": "unknown", "both empty": "unknown",
        "no sql": "error", "no db": "error",
    }


def test_augmenting_matching_is_maximum():
    rnd = random.Random(3)
    for _ in range(200):
        n, m = rnd.randrange(1, 6), rnd.randrange(1, 6)
        edges = {p: [g for g in range(m) if rnd.random() < 0.4] for p in range(n)}
        pairs = [(p, g) for p, gs in edges.items() for g in gs]
        flow = C._flows(pairs, {p: 1 for p, _ in pairs}, {g: 1 for _, g in pairs})
        match = dict([*flow])
        assert set(flow.values()) <= {1} and len(match) == len(flow)
        assert len(set(match.values())) == len(match)
        assert all(g in edges[p] for p, g in match.items())
        best = max(
            sum(1 for p, g in zip(range(n), perm) if g in edges[p])
            for perm in itertools.permutations(list(range(m)) + [-1] * n, n)
        )
        assert len(match) == best


def test_multiset_compare(spark):
    got = C.multiset_compare(
        cells(
            spark,
            {
                "reversed": ([["a"], ["b"]], [["B"], ["a "]]),
                "repeats": ([["a"], ["a"]], [["a"]]),
                "other": ([["a"]], [["b"]]),
            },
        )
    )
    assert {r[0]: r[1] for r in got.collect()} == {"reversed": True, "repeats": True, "other": False}


def test_column_type_by_last_row(spark):
    flags = C.compare_positional(cells(spark, {"q": ([["POINT(1 2)"], ["x"]], [["POINT(1 2)"], ["x"]])}))
    kinds = [C.column_stats(flags, column_type=t).first()["column_type"] for t in ("whole", "last_row")]
    assert kinds == ["text", "text"]


def test_run_pairs_keeps_order_and_errors(spark):
    spark.range(1000).selectExpr("id", "id % 7 AS k").createOrReplaceTempView("numbers")
    got, status = run_pairs(
        spark,
        [
            ("a", "SELECT id FROM numbers ORDER BY id DESC", "SELECT id FROM numbers ORDER BY id DESC;"),
            ("b", "SELECT id FROM nowhere", "SELEC 1"),
            ("c", "SELECT id, id AS id FROM numbers WHERE k > 9", "SELECT 1 / (k - 3) FROM numbers"),
        ],
    )
    rows = got.where("query_id = 'a' AND side = 'pred'").orderBy("row_idx").collect()
    assert [(r["row_idx"], r["value"]) for r in rows] == [(i, str(999 - i)) for i in range(1000)]
    state = {(r["query_id"], r["side"]): r for r in status.collect()}
    assert len(state) == 6
    assert [state[k]["executable"] for k in sorted(state)] == [True, True, False, False, True, False]
    assert "nowhere" in state[("b", "gold")]["error"]
    assert "DIVIDE_BY_ZERO" in state[("c", "pred")]["error"]
    assert state[("a", "gold")]["ordered"] and not state[("c", "gold")]["ordered"]


@pytest.mark.parametrize(
    ("json", "rows"),
    [
        ('" x "', [["x"]]),
        ('[["a", 1], ["b", null]]', [["a", "1"], ["b", None]]),
        ('[{"n": 1.5}, {"m": true}]', [["1.5", ""], ["", "true"]]),
        ('{"m": "v"}', [["", "v"]]),
        ("[]", []),
        ("null", [["", ""], ["", ""]]),
        ("7", [["", ""], ["", ""]]),
        ('[1, "x"]', [["", ""], ["", ""]]),
        ('[[1], {"n": 2}]', [["", ""], ["", ""]]),
    ],
)
def test_expected_rows(spark, json, rows):
    df = spark.createDataFrame([(json, ["n", "m"])], "j STRING, names ARRAY<STRING>")
    got = df.select(C.expected_rows(F.parse_json("j"), F.col("names"), F.lit(2)).alias("r")).first()["r"]
    assert got == rows


def test_only_whole_geometries_decode(spark):
    good = [
        "POINT(1 2)", "point z ( 1 2 3 )", "LINESTRING(0 0,1 1)", "POLYGON((0 0,1 0,1 1,0 0))", "POLYGON((0 0,1 0,1 1,0.0 0e0),(1 1,2 1,2 2,1 1))",
        "MULTIPOINT(1 2,3 4)", "MULTIPOINT((1 2),(3 4))", "MULTILINESTRING((0 0,1 1),(2 2,3 3))", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))",
        "GEOMETRYCOLLECTION(POINT(1 2), LINESTRING(0 0,1 1))", "GEOMETRYCOLLECTION(GEOMETRYCOLLECTION(POINT(1 2)),POINT EMPTY)", "SRID=4326;POINT(1 2)",
        "LINESTRING(" + ",".join(f"{k} {k}" for k in range(20_000)) + ")",
    ]
    bad = [
        "POINT(1 2,3 4)", "POINT(1)", "POINT()", "LINESTRING(1 2)", "LINESTRING(1 2,)", "POLYGON((0 0,1 0,1 1,0 1))", "POLYGON((0 0,1 0,0 0))",
        "POLYGON(0 0,1 0,1 1,0 0)", "POLYGON((0 0,1 0,1 1,0 0),(1 1,2 1,2 2,9 9))", "MULTIPOINT((1 2,3 4))", "MULTIPOLYGON((0 0,1 0,1 1,0 0))",
        "GEOMETRYCOLLECTION(foo)", "GEOMETRYCOLLECTION(POINT(1 2,3 4))", "GEOMETRYCOLLECTION(POLYGON((0 0,1 0,1 1,5 5)))", "POINT(1 2))", "POINT(a b)",
    ]
    df = spark.createDataFrame([(t, t in good) for t in good + bad], "t STRING, ok BOOLEAN")
    wrong = df.where(G.decode_geom("t").isNotNull() != F.col("ok")).collect()
    assert [r.t for r in wrong] == []
    pair = [("POLYGON((0 0,1 0,1 1,0 1))", "POLYGON((0 0,1 0,1 1,5 5))"), ("GEOMETRYCOLLECTION(foo)", "GEOMETRYCOLLECTION(bar)")]
    assert {r[0] for r in equal(spark, pair)} == {False}


def test_many_equal_geometry_columns_cost_one_pair(spark):
    n = 30
    rows = [["POINT(1 2)"] * n + ["x"], ["POINT(3 4)"] * n + ["y"]]
    df = cells(spark, {"q": (rows, rows), "fewer": (rows, [[*r[:n - 1], "POINT Z (1 2 9)"] for r in rows])})
    prints = C.column_prints(df)
    assert C.geometry_edges(df, prints).where("query_id = 'q'").count() == 1
    got = C.match_columns(df, prints=prints).where("query_id = 'q'").collect()
    assert sorted(r.pred_col for r in got) == sorted(r.gold_col for r in got) == list(range(n + 1))
    assert verdicts(score_matched(df)) == {"q": "correct", "fewer": "incorrect"}
