"""User callables and the resumable store on literal rows."""

import time

import pytest

from scoreframe.operators import runs as R
from scoreframe.streaming import append_new, follow_runs


def test_one_bad_text_costs_one_row(spark):
    calls = [(k, f"t{k}" if k != 5 else "bad") for k in range(20)]

    def embed(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[float(t[1:])] for t in texts], 10

    df = spark.createDataFrame(calls, "id INT, text STRING").coalesce(1)
    got = {r.id: r for r in R.batch_embed(df, embed, delay=0.0, batch_size=8).collect()}
    assert len(got) == 20 and got[5].vector is None and got[5].embed_error == "ValueError: no"
    assert all(got[k].vector == [float(k)] and got[k].embed_error is None for k in got if k != 5)
    # Tokens are those of the calls that succeeded: 4, 1, 2 texts beside the bad one, then 8 and 4.
    assert sum(r.embed_tokens for r in got.values()) == 50


def test_predictions_keep_their_order_and_overlap(spark):
    def slow(prompt):
        time.sleep(0.2 if prompt == "0" else 0.05)
        return f"a{prompt}", 1

    df = spark.createDataFrame([(k, str(k)) for k in range(32)], "id INT, prompt STRING").coalesce(1)
    start = time.time()
    got = R.batch_predict(df, slow, in_flight=16).collect()
    assert [(r.id, r.response) for r in got] == [(k, f"a{k}") for k in range(32)]
    assert len({r.thread_id for r in got}) > 1 and max(r.start_time for r in got) - min(r.start_time for r in got) < 1.2
    assert time.time() - start < 30


def test_store_has_each_key_once_and_errors_are_not_swallowed(spark, tmp_path):
    schema = "model STRING, unique_key STRING, ord BIGINT, v STRING"
    path, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    first = [("m", f"k{k}", k, "old") for k in range(50)] + [("m", "k1", 99, "later"), ("m", "", 100, "none")]
    spark.createDataFrame(first, schema).write.json(path)
    append_new(follow_runs(spark, path, schema), store, state, parts=4).awaitTermination()
    more = [("m", f"k{k}", k, "new") for k in range(40, 60)] + [("n", "k1", 1, "other model")]
    spark.createDataFrame(more, schema).write.mode("append").json(path)
    append_new(follow_runs(spark, path, schema), store, state, parts=4).awaitTermination()
    rows = spark.read.parquet(store).collect()
    assert sorted((r.model, r.unique_key) for r in rows) == sorted([("m", f"k{k}") for k in range(60)] + [("n", "k1")])
    assert {r.v for r in rows if r.model == "m" and int(r.unique_key[1:]) < 50} == {"old"}
    blocked = tmp_path / "blocked"
    blocked.write_text("a file, not a store")
    with pytest.raises(Exception):
        append_new(follow_runs(spark, path, schema), str(blocked), str(tmp_path / "s2")).awaitTermination()


def test_a_batch_is_shuffled_once(spark, tmp_path, monkeypatch):
    """First rows and the join with the stored keys need one shuffle of the batch and one of the stored keys."""
    from scoreframe.sources import append_runs
    from scoreframe.streaming import resume

    plans, unstored = [], resume._unstored

    def spy(*args):
        out = unstored(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(resume, "_unstored", spy)
    schema = "model STRING, unique_key STRING, ord BIGINT, v STRING"
    path, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for v, keys in (("old", range(30)), ("new", range(20, 40))):
            data = [("m", f"k{k % 35}", k, v) for k in keys] + [("m", None, 1, v), ("m", "k3", 99, v)]
            append_runs(spark.createDataFrame(data, schema), path, compression="lz4")
            append_new(follow_runs(spark, path, schema), store, state, parts=4).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = spark.read.parquet(store).collect()
    want = {("m", f"k{k}", "old", k) for k in range(30)} | {("m", f"k{k}", "new", k) for k in range(30, 35)}
    assert len(rows) == len(want) and {(r.model, r.unique_key, r.v, r.ord) for r in rows} == want
    assert [p.count("Exchange hashpartitioning") for p in plans] == [2]
    assert all(f.name.endswith(".json.lz4") for f in (tmp_path / "in").glob("part-*"))


def test_a_long_batch_takes_more_tasks(spark, tmp_path, monkeypatch):
    """Also with a frequent key, which is a part of its own, and over two batches."""
    from scoreframe import session

    monkeypatch.setattr(session, "ROWS_PER_TASK", 20)
    schema = "model STRING, unique_key STRING, ord BIGINT, v STRING"
    path, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    for v, more in (("old", 0), ("new", 50)):
        data = [("m", "hot" if k % 3 == 0 else f"k{k + more}", k, v) for k in range(600)]
        spark.createDataFrame(data, schema).write.mode("append").json(path)
        append_new(follow_runs(spark, path, schema), store, state, parts=4).awaitTermination()
    rows = spark.read.parquet(store).collect()
    want = {("hot", "old", 0)} | {(f"k{k}", "old", k) for k in range(600) if k % 3}
    want |= {(f"k{k + 50}", "new", k) for k in range(600) if k % 3 and not ((k + 50) % 3 and k + 50 < 600)}
    assert len(rows) == len(want) and {(r.unique_key, r.v, r.ord) for r in rows} == want
