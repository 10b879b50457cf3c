"""A JSON array that many tasks read, against the reader of the standard library."""

import json
import random

import pytest

from scoreframe import sources as IO
from scoreframe.sources import reads

BITS = ["{", "}", "[", "]", '"', "\\", ",", ":", "a", "é", "日", " ", "\n", "}]", '\\"}', "\\\\"]


def value(r, depth=0):
    kind = r.randrange(6 if depth < 3 else 4)
    if kind == 0:
        return "".join(r.choice(BITS) for _ in range(r.randint(0, 12)))
    if kind < 4:
        return r.choice([None, True, 1.5, -7])
    if kind == 4:
        return [value(r, depth + 1) for _ in range(r.randint(0, 3))]
    return {"".join(r.choice(BITS) for _ in range(r.randint(0, 3))): value(r, depth + 1) for _ in range(r.randint(0, 3))}


def items(spark, path):
    return [json.loads(r.item) for r in reads.read_json_array(spark, str(path)).orderBy("file", "idx").collect()]


@pytest.mark.parametrize("block", ["128m", "200", "37"])
def test_as_the_standard_reader(spark, tmp_path, block):
    r = random.Random(1)
    want = []
    for k in range(6):
        array = [{"k": value(r), "v": value(r)} if r.random() < 0.9 else {} for _ in range(r.choice([0, 1, 3, 60]))]
        text = json.dumps(array, ensure_ascii=k % 2 == 0, indent=r.choice([None, 2]))
        (tmp_path / f"{k}.json").write_text("\ufeff" * (k == 3) + text + "\n" * (k % 3), encoding="utf-8")
        want += array
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert items(spark, tmp_path) == want
        if block == "200":
            assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": 1}}]', '{"a": 1}', '[{"a": "x}]', '[1, {"a": 1}]', '[{"a": 1} {"b": 2}]', '[{"a": 1}, 2]', "x[]", '[{"a": 1}] x'])
def test_others_raise(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="no JSON array of objects"):
        items(spark, tmp_path)


def test_signatures(spark, tmp_path):
    rows = [{"function_name": f"f{k}", "input_types": ["int"] * (k % 3), "variadic": ["True", True, False, None][k % 4]} for k in range(50)]
    (tmp_path / "s.json").write_text(json.dumps(rows))
    got = sorted(IO.read_signatures(spark, str(tmp_path)).collect(), key=lambda r: r.sig_ord)
    assert [(g.function_name, g.input_types, g.variadic, g.sig_ord) for g in got] == [
        (s["function_name"], s["input_types"], str(s["variadic"]).lower() == "true", k) for k, s in enumerate(rows)
    ]
