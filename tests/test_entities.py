"""Entities against the standard library, without Python in the plan."""

import html
import html.entities
import random

from pyspark.sql import functions as F

from scoreframe.functions import text as X


def decoded(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    return [r.u for r in df.withColumn("u", X.unescape("t")).orderBy("i").collect()]


def test_every_name_and_many_numbers(spark):
    names = [f"a&{n}b" for n in html.entities.html5] + [f"&{n.rstrip(';')}" for n in html.entities.html5]
    numbers = [0, 1, 9, 10, 11, 12, 13, 31, 32, 38, 127, *range(128, 162), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0xFFFF]
    numbers += [0x1F642, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000, 99999999999, 10**30, 2**64 + 65]
    texts = names + [f"&#{n};x" for n in numbers] + [f"&#{n}x" for n in numbers] + [f"&#x{n:x};" for n in numbers] + [f"&#X000{n:X} " for n in numbers]
    got = decoded(spark, texts)
    assert [(t, g) for t, g in zip(texts, got) if g != html.unescape(t)] == []


def test_random_texts(spark):
    r = random.Random(1)
    bits = ["&", "amp", "lt", "gt;", "notit", "not", ";", "#", "x41", "65", "é", " ", "\n", "&amp;", "&lt", "&nbsp;", "&copy", "&#x", "&#", "CounterClockwiseContourIntegral;", "a", "$1", "\\"]
    texts = [None, "", "&", "&&", "&;"] + ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(3000)] + ["x" * 50_000 + "&amp;" * 5000]
    got = decoded(spark, texts)
    assert [(t, g) for t, g in zip(texts, got) if t is not None and g != html.unescape(t)] == [] and got[0] is None


def test_no_python_in_the_plan(spark):
    df = spark.range(1).selectExpr("concat('&lt;think&gt;x&lt;/think&gt; B', repeat(' ', int(id))) AS t").select(X.final_answer("t").alias("a"), F.col("t"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    # Names of arrows are among the entities; the operators would be these.
    assert not any(op in plan for op in ("EvalPython", "InArrow", "InPandas")) and df.first()["a"] == "B"
