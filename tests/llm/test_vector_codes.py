import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from scoreframe.llm import vector_codes

from .awkward import CLASHES

SCHEMA = StructType(
    [StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("label", IntegerType())]
    + [StructField(c, StringType()) for c in [*CLASHES, "id", "v", "codes", "error"]]
)


def table(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * (len(SCHEMA) - 3)) for r in rows], SCHEMA).repartition(3)


def brute(rows, parts=8, entries=16, rounds=6):
    """The contract in plain integers: (id, codes, error) per row that stays, and the digest of the books."""
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(4096 * float(np.float32(x)))) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    cut = [k * size // parts for k in range(parts + 1)]
    books = [[r[1][a:b] for r in kept[:entries]] for a, b in zip(cut, cut[1:])]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p, (a, b) in enumerate(zip(cut, cut[1:])):
            got = defaultdict(list)
            for r in kept:
                got[nearest(p, r[1][a:b])[1]].append(r[1][a:b])
            for e, xs in got.items():
                new[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
        books = new
    out = []
    for i, v, label in kept:
        found = [nearest(p, v[a:b]) for p, (a, b) in enumerate(zip(cut, cut[1:]))]
        out.append((i, label, tuple(e for _, e in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def check(spark, rows, **options):
    found, books = vector_codes.compress(table(spark, rows), **options)
    want, digest = brute(rows, **options)
    got = [(r.id, r.label, tuple(r.codes), r.error) for r in found.collect()]
    assert Counter(got) == Counter((i, n, c, e if e < 1 << 63 else None) for i, n, c, e in want)
    assert books.digest() == digest
    sums = defaultdict(int)
    for _, label, _, e in want:
        sums[label] += e
    errors = {r.label: r.label_error for r in vector_codes.label_errors(found).collect()}
    assert errors == {k: v if v < 1 << 63 else None for k, v in sums.items()}
    return found, books


def vectors(n, size, seed=1):
    r = random.Random(seed)
    middles = [[r.uniform(-1, 1) for _ in range(size)] for _ in range(20)]
    return [(k, [x + r.gauss(0, 0.05) for x in r.choice(middles)], r.choice([None, 0, 1, 2])) for k in range(n)]


def test_as_brute_force(spark):
    rows = vectors(300, 24)
    found, books = check(spark, rows)
    codes = np.array([r.codes for r in found.orderBy("id").collect()])
    near = np.abs(books.decode(codes) - np.array([v for _, v, _ in rows])).mean()
    assert near < 0.15


@pytest.mark.parametrize("options", [{"parts": 3, "entries": 5, "rounds": 2}, {"parts": 1, "entries": 300, "rounds": 1}, {"rounds": 0}])
def test_options(spark, options):
    check(spark, vectors(80, 10), **options)


def test_blocks_of_any_size(spark, monkeypatch):
    rows = vectors(200, 16)
    for values in (16, 16 * 7, 1 << 20):
        monkeypatch.setattr(vector_codes, "BLOCK_VALUES", values)
        check(spark, rows)


def test_awkward_rows(spark):
    rows = vectors(60, 16, seed=2)
    rows += [rows[3], rows[3], (3, rows[7][1], 5), (None, rows[5][1], None), (None, rows[6][1], 1), (None, None, None)]
    rows += [(-5, None, 1), (-4, [None] * 16, 1), (-3, [float("nan")] + [0.1] * 15, 1), (-2, [float("inf")] * 16, 1), (70, [-float("inf")] * 16, 2)]
    rows += [(71, [], 1), (72, [0.5] * 15, 1), (73, [0.5] * 17, 1), (74, [0.0] * 16, 1), (75, [-0.0] * 16, 1), (76, [1e-30, -1e-30] * 8, 1)]
    check(spark, rows)


def test_few_tied_and_no_rows(spark):
    check(spark, [(1, [0.25] * 8, None)])
    check(spark, [(k, [0.25] * 8, 1) for k in range(40)])
    check(spark, [(k % 2, [0.25, -0.75] * 4, 1) for k in range(20)])
    check(spark, [(k, [], None) for k in range(3)])
    check(spark, [])
    check(spark, [(1, None, 2)])


def test_large_components(spark):
    """Distances over 64 bits: exact codes and books, errors a long doesn't hold are null."""
    rows = vectors(40, 8) + [(50, [3e5 * k for k in range(8)], 1), (51, [-1e13] * 8, 7), (52, [1e13] * 8, 7), (1, [2e14] * 8, 8)]
    check(spark, rows)
    found, _ = vector_codes.compress(table(spark, [*rows, (99, [1e30] * 8, 1)]))
    assert found.where(F.col("id") == 99).count() == 0
