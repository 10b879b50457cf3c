"""A small table with the cases every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

CLASHES = ["_row", "_id", "_digest", "row", "uid", "piece", "kept", "fp", "digest", "tokens", "score", "part", "items"]
SCHEMA = StructType(
    [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
     StructField("source", StringType()), StructField("n_chars", LongType())]
    + [StructField(c, StringType()) for c in CLASHES]
)


def rows():
    r = random.Random(3)
    words = ["alpha", "Beta", "gamma", "délta", "ünder", "Öl", "10", "x", "the", "of", "日本", "e"]
    long = " ".join(r.choice(words) for _ in range(30_000))
    texts = [
        None, "", "", " ", "one", "One", "ONE", "ÉCOLE", "école", "two words", "three words here", long, long[:-1] + "!",
        "x" * 3000, "a b " * 700, "\n\n\t", "…", "12345", "mail bob@example.com or call +1 (202) 555-0123 now",
    ]
    texts += [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(40)]
    texts += [texts[k] for k in (4, 9, 20, 21)]
    out = [(k, t, "en" if t else None, f"s{k % 3}", len(t) if t else None) for k, t in enumerate(texts)]
    out += [out[20], out[20], (None, "one", None, None, None), (None, None, None, None, None), (9, "other text", "fr", None, 1)]
    return [(*x, *["clash"] * len(CLASHES)) for x in out]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
