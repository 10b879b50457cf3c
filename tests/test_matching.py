"""Matching by classes with capacities, and the order of long results."""

import itertools
import random
import time

import pytest

from scoreframe.operators import cells as C


def most(edges, supply, room):
    """The largest number of pairs, by augmenting paths over single columns."""
    golds = {(g, j): None for g, n in room.items() for j in range(n)}

    def place(p, seen):
        for g, j in golds:
            if (p[0], g) in edges and (g, j) not in seen:
                seen.add((g, j))
                if golds[g, j] is None or place(golds[g, j], seen):
                    golds[g, j] = p
                    return True
        return False

    return sum(place((p, i), set()) for p, n in supply.items() for i in range(n))


def test_flows_are_largest():
    r = random.Random(1)
    for _ in range(400):
        supply = {p: r.randint(1, 4) for p in range(r.randint(1, 5))}
        room = {10 + g: r.randint(1, 4) for g in range(r.randint(1, 5))}
        edges = [e for e in itertools.product(supply, room) if r.random() < 0.5]
        used = {p for p, _ in edges}
        flow = C._flows(edges, supply, room)
        assert set(flow) <= set(edges) and min(flow.values(), default=1) > 0
        for p, n in supply.items():
            assert sum(k for (q, _), k in flow.items() if q == p) <= n
        for g, n in room.items():
            assert sum(k for (_, h), k in flow.items() if h == g) <= n
        assert sum(flow.values()) == most(set(edges), {p: n for p, n in supply.items() if p in used}, room)


def test_large_classes_are_one_edge():
    start = time.perf_counter()
    assert C._flows([(0, 1)], {0: 1_000_000}, {1: 999_999}) == {(0, 1): 999_999}
    chain = [(k, k) for k in range(300)] + [(k, k + 1) for k in range(299)]
    assert sum(C._flows(chain, dict.fromkeys(range(300), 10**6), dict.fromkeys(range(300), 10**6)).values()) == 300 * 10**6
    assert time.perf_counter() - start < 5


def cells(spark, tables):
    rows = [(q, side, i, j, f"c{j}", v) for (q, side), table in tables.items() for i, row in enumerate(table) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "query_id STRING, side STRING, row_idx INT, col_idx INT, col_name STRING, value STRING")


def test_two_thousand_equal_columns(spark):
    """Shapes equal, texts of two kinds: three classes a side, every column gets one of its own."""
    n = 2000
    pred = [["POINT(1 2)"] * n + ["POINT(1.0 2)"] * 5, ["POINT(3 4)"] * n + ["POINT(3 4.0)"] * 5]
    gold = [["POINT( 1 2)"] * 7 + ["POINT(1 2)"] * (n - 2), ["POINT(3 4)"] * 7 + ["POINT(3 4)"] * (n - 2)]
    df = cells(spark, {("q", "pred"): pred, ("q", "gold"): gold})
    prints = C.column_prints(df)
    edges = C.geometry_edges(df, prints)
    assert edges.count() == 4
    got = C.match_columns(df, prints=prints).collect()
    assert sorted(r.pred_col for r in got) == sorted(r.gold_col for r in got) == list(range(n + 5))


def ordered(table, spec):
    rows = list(enumerate(table))
    for col, up in reversed(spec):
        # Nulls are least; a falling order turns that over and keeps ties in place.
        key = lambda r: (r[1][col] is not None, (r[1][col] or "").encode())
        rows.sort(key=key, reverse=not up)
    return [i for i, _ in rows]


@pytest.mark.parametrize("parts", [None, 1, 7])
def test_rows_in_the_order_asked_for(spark, parts):
    r = random.Random(2)
    words = [None, "", "a", "aa", "b", "A", "é", "日", "a!", "a~", "10", "9", " "]
    tables, specs, want = {}, [], {}
    for k in range(12):
        side, cols = r.choice(["pred", "gold"]), 3
        tables[f"q{k}", side] = table = [[r.choice(words) for _ in range(cols)] for _ in range(r.choice([1, 5, 80, 400]))]
        spec = [(c, r.random() < 0.5) for c in r.sample(range(cols), r.randint(1, 3))]
        specs.append((f"q{k}", side, [(f"c{c}", up) for c, up in spec] + [("other", True)]))
        want[f"q{k}"] = ordered(table, spec)
    spec_df = spark.createDataFrame(specs, "query_id STRING, side STRING, spec ARRAY<STRUCT<column: STRING, ascending: BOOLEAN>>")
    got = C.ordered_rows(cells(spark, tables), spec_df, parts=parts).collect()
    for q, rows in want.items():
        mine = sorted((g.place, g.row_idx) for g in got if g.query_id == q)
        assert mine == list(enumerate(rows, 1))


def test_a_long_result_is_dealt_over_all_stretches(spark):
    df = spark.range(20_000).selectExpr("'q' AS query_id", "'pred' AS side", "int(id) AS row_idx", "0 AS col_idx", "'c' AS col_name", "string(id % 7) AS value")
    spec = spark.createDataFrame([("q", "pred", [("c", False)])], "query_id STRING, side STRING, spec ARRAY<STRUCT<column: STRING, ascending: BOOLEAN>>")
    placed = C.ordered_rows(df, spec, parts=8)
    rows = sorted((r.place, r.row_idx) for r in placed.collect())
    assert [i for _, i in rows] == sorted(range(20_000), key=lambda i: (-(i % 7), i))
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_stretch") > 0
