"""Order, dedup and pass rates against plain Python on random rows."""

import random
from itertools import groupby

from pyspark.sql import functions as F

from scoreframe.operators import metrics as M
from scoreframe.operators import order as R
from scoreframe.operators import runs as P


def rows(n=3000, seed=7):
    rnd = random.Random(seed)
    # One item holds a third of all rows.
    return [
        (
            rnd.choice("ab"),
            0 if rnd.random() < 0.33 else rnd.randrange(1, 300),
            rnd.randrange(1, 7),
            rnd.choice([None, "", "hot", f"k{rnd.randrange(900)}"]),
            rnd.choice(["correct", "incorrect", "unknown"]),
            i,
        )
        for i in range(n)
    ]


DDL = "model STRING, id INT, round INT, unique_key STRING, result_correct STRING, ord BIGINT"


def test_dedup_first(spark):
    data = rows()
    seen, want = set(), []
    for r in data:
        if r[3] and (r[0], r[3]) not in seen:
            seen.add((r[0], r[3]))
            want.append(r)
    got = R.dedup_first(spark.createDataFrame(data, DDL).repartition(5)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[5]) == want


def test_last_per_key(spark):
    data = rows()
    want = {(r[0], r[1]): r[5] for r in data}
    got = R.last_per_key(spark.createDataFrame(data, DDL), ["model", "id"]).collect()
    assert {(r[0], r[1]): r[5] for r in got} == want


def test_last_per_key_settles_ties(spark):
    """Of rows of one order the least by ``ties`` stays, whichever way they come."""
    data = [("m", 1, 5, k) for k in range(20)]
    for rows in (data, data[::-1]):
        df = spark.createDataFrame(rows, "model string, id int, ord int, place int").coalesce(1)
        assert [r.place for r in R.last_per_key(df, ["model", "id"], "ord", ["place"]).collect()] == [0]


def test_running_index_and_sortedness_across_stretches(spark):
    data = rows()
    df = spark.createDataFrame(data, DDL).repartition(6)
    for parts in (1, 7, 200):
        got = R.running_index(df, ["model"], ["ord"], "i", parts).collect()
        by_model = {}
        for r in sorted(got, key=lambda r: r["ord"]):
            by_model.setdefault(r["model"], []).append(r["i"])
        assert all(v == list(range(1, len(v) + 1)) for v in by_model.values())
        want = {}
        for r in data:
            want.setdefault((r[0], r[1]), []).append(r[2])
        flags = R.is_sorted_within(df, ["model", "id"], parts=parts).collect()
        assert {(r[0], r[1]): r[2] for r in flags} == {k: v == sorted(v) for k, v in want.items()}


def test_pass_at_k_by_item_and_by_position(spark):
    data = rows()
    df = spark.createDataFrame(data, DDL)
    items = {}
    for r in sorted(data, key=lambda r: (r[0], r[1], r[2], r[5])):
        items.setdefault((r[0], r[1]), []).append(r[4] == "correct")
    for r in M.pass_at_k(df).collect():
        mine = [v for (m, _), v in items.items() if m == r["model"]]
        assert r["num_samples"] == len(mine)
        assert [r[f"pass_{k}_count"] for k in (1, 3, 5)] == [sum(any(v[:k]) for v in mine) for k in (1, 3, 5)]
    for r in M.pass_at_k(df, order=("ord",), positional=True, parts=9).collect():
        mine = [x[4] == "correct" for x in data if x[0] == r["model"]]
        groups = [mine[i * 5 : i * 5 + 5] for i in range(len(mine) // 5)]
        assert r["num_samples"] == len(groups)
        assert [r[f"pass_{k}_count"] for k in (1, 3, 5)] == [sum(any(g[:k]) for g in groups) for k in (1, 3, 5)]


def test_stability_of_zero_rates(spark):
    data = [("m", 1, r, "k", "incorrect", r) for r in range(1, 6)]
    row = M.stability(M.pass_at_k(spark.createDataFrame(data, DDL))).first()
    assert row["pass@5_std_cv"] == float("inf") and row["stability_adjusted_accuracy"] == 0.0
    assert M.stability(M.pass_at_k(spark.createDataFrame([], DDL))).count() == 0


def test_pending_and_retries(spark):
    tasks = P.expand_rounds(spark.range(4), 3, ["x", "y", "x"]).withColumn("unique_key", P.unique_key("id", "round", "model"))
    assert tasks.count() == 24
    done = tasks.where("round < 3").union(tasks.where("round = 1"))
    assert P.pending(tasks, done).where("round < 3").count() == 0
    assert P.pending(tasks, done).count() == 8
    df = spark.createDataFrame([("ok",), ("slow",), ("bad",)], "prompt STRING")

    def fn(p):
        if p == "slow":
            raise OSError("Connection error")
        return {"ok": ("fine", 3)}[p]

    got = {r["prompt"]: (r["response"], r["tokens_used"], r["error"]) for r in P.batch_predict(df, fn, delay=0.0).collect()}
    assert got["ok"] == ("fine", 3, None)
    assert got["slow"] == ("", 0, "failed after 3 attempts: Connection error")
    assert got["bad"][2].startswith("KeyError")


def test_resource_usage_of_one_row(spark):
    df = spark.createDataFrame([("m", 2.0, 5)], "model STRING, duration DOUBLE, tokens_used BIGINT")
    row = M.resource_usage(df).first()
    assert (row["average_duration_sec"], row["mean_duration_sec"]) == (None, 2.0)


def test_reorder_keeps_file_order_of_equal_rounds(spark):
    data = rows(500)
    df = spark.createDataFrame(data, DDL).withColumns({"function": F.lit("f"), "question": F.lit("q")})
    got = [(r["id"], r["round"], r["ord"]) for r in R.reorder_runs(df).collect()]
    assert got == sorted(got)
    assert [k for k, _ in groupby(g[0] for g in got)] == sorted({r[1] for r in data})


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """A task's share of a sort stays the same however many rows there are."""
    from scoreframe import session

    monkeypatch.setattr(session, "ROWS_PER_TASK", 10)
    df = spark.createDataFrame(rows(), DDL)
    n = -(-df.count() // 10)
    assert n > 8
    for found in (R.is_sorted_within(df, ["model"]), R.running_index(df, ["model"], ["ord"], "i")):
        text = found._jdf.queryExecution().toString()
        assert f", {n}), REPARTITION_BY_NUM" in text


def test_pass_at_k_in_as_many_tasks_as_needed(spark, monkeypatch):
    """A large table is dealt by item among more tasks, a frequent item apart; the rates stay the same."""
    from scoreframe import session
    from scoreframe.operators.order import dealt, first_n

    r = random.Random(8)
    data = [("m", 7 if k % 3 == 0 else k // 6, r.randint(1, 9), "k", r.choice(["correct", "incorrect", None]), k) for k in range(3000)]
    df = spark.createDataFrame(data, DDL).repartition(5)
    want, first = M.pass_at_k(df).collect(), set(first_n(df, ["model", "id"], ["round", "ord"], 2).collect())
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    parts = dealt(df, ["model", "id"])
    assert [p.count() for p in parts] == [3000 - 1004, 1004] and {x["id"] for x in parts[1].collect()} == {7}
    found = M.pass_at_k(df)
    assert found.collect() == want
    assert "model#" in (text := found._jdf.queryExecution().toString()) and ", 30), REPARTITION_BY_NUM" in text
    assert set(first_n(df, ["model", "id"], ["round", "ord"], 2).collect()) == first
