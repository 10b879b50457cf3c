"""Literal texts for each rule of answer cleaning."""

import pytest
from pyspark.sql import functions as F

from scoreframe.functions import text as X


def run(spark, fn, *values):
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, "i INT, v STRING")
    return [r[1] for r in sorted(df.select("i", fn(F.col("v")).alias("o")).collect())]


def test_final_answer(spark):
    got = run(
        spark, X.final_answer,
        "The answer is B.", "it is a dog", "<think>A</think> true", "<think>never closed C",
        "&lt;THINK x=1&gt;D&lt;/think&gt; falsE", "", None, "abcd", "été À Bé", "A, C",
    )
    # The article "a" counts as A; letters inside words do not, accented words included.
    assert got == ["B", "A", "True", "", "False", "", "", "", "", "C"]


def test_final_answer_reads_the_end_only(spark):
    assert run(spark, X.final_answer, "C " + "x" * 240) == [""]
    assert run(spark, X.final_answer, "C" + " x" * 100) == ["C"]


@pytest.mark.parametrize(
    ("text", "sql"),
    [
        ("```sql\nSELECT 1\n```\nor\n```\nSELECT 2\n```", "SELECT 2"),
        ("``````", ""),  # an empty fence still decides
        ("```sql\nSELECT 3", "SELECT 3"),
        ("say\nSELECT 4;\nthen SELECT 5; end", "SELECT 4;"),
        ("SELECT 6;SELECT 7;  \n", "SELECT 6;SELECT 7;"),
        ("select a\nfrom t", "select a"),  # without an end, one line is kept
        ("with love", "with love"),  # prose may look like a statement
        ("nothing", ""),
        ("<think>SELECT 8;</think>", ""),
        ("x SELECT 9;\r\nmore", "SELECT 9;"),
        ("SELECT 10; -- a\nDROP t;", "SELECT 10; -- a\nDROP t;"),
    ],
)
def test_extract_sql(spark, text, sql):
    assert run(spark, X.extract_sql, text) == [sql]


def test_extract_sql_keeps_long_texts_whole(spark):
    long = "with " * 40_000 + "SELECT 1;\n" + "and with words " * 20_000
    assert run(spark, X.last_statement, long) == [("with " * 40_000 + "SELECT 1;")]


def test_strip_fences_and_labels(spark):
    assert run(spark, X.strip_fences, "```sql\n SELECT 1 ```", "```x```", "'\"a\"'", None) == [
        "SELECT 1", "x", "\"a\"", None,
    ]
    assert run(spark, X.clean_label, " `Missing Objects`\n", "a\r\nb", "", None) == [
        "Missing Objects", "a", "", "",
    ]


def test_keys_and_identifiers(spark):
    assert run(spark, X.type_key, " a-b c!", "", None, "éé") == ["A_B_C", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert run(spark, X.norm_answer, " b , a ,,", None) == ["B,A", ""]
    assert run(spark, X.norm_ident, ' "Tab" ', None) == ["tab", ""]


def test_reasoning(spark):
    df = spark.createDataFrame([("a", "why"), ("b", None), ("c", "")], "t STRING, r STRING")
    out = df.select(X.wrap_reasoning("t", "r").alias("w")).select("w", X.unwrap_reasoning("w").alias("u"))
    assert [tuple(r) for r in out.collect()] == [
        ("<think>\nwhy\n</think>\n\na", "whya"), ("b", "b"), ("c", "c"),
    ]
