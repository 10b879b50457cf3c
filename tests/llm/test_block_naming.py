import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scoreframe.llm import block_naming
from scoreframe.llm.common import UPPER, LOWER

from . import awkward

AZ = str.maketrans(UPPER, LOWER)


def norm(t):
    return (t or "").translate(AZ)


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    out = []
    for r in rows:
        ids = groups[norm(r[1])]
        best = max(ids, key=lambda i: (i is not None, i or 0))
        out.append((r[0], best, len(ids), hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    return Counter(out)


def found(df):
    rows = df.collect()
    return Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), rows


@pytest.mark.parametrize("block_bytes", [1024, 7])
def test_against_brute_force(spark, block_bytes):
    got, rows = found(block_naming.exact_duplicates(awkward.docs(spark), block_bytes=block_bytes))
    assert got == brute(awkward.rows())
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({norm(r[1]) for r in awkward.rows()})
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_buckets_that_collide(spark):
    """Three buckets for all blocks and pairs: the bytes must still decide."""
    weak = lambda *c: F.pmod(F.xxhash64(*c), F.lit(3))
    small = awkward.docs(spark).where("length(text) < 400 OR text IS NULL")
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    got, _ = found(block_naming.exact_duplicates(small, block_bytes=16, bucket=weak))
    assert got == brute(rows)


def test_filter_keeps_columns(spark):
    docs = awkward.docs(spark)
    kept = block_naming.drop_exact_duplicates(docs)
    assert kept.schema == docs.schema
    texts = [norm(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({norm(r[1]) for r in awkward.rows()})


def test_empty(spark):
    assert block_naming.exact_duplicates(awkward.empty(spark)).count() == 0
    assert block_naming.drop_exact_duplicates(awkward.empty(spark)).count() == 0
