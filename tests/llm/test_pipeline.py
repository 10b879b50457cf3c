import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from scoreframe.llm import simhash_index
from scoreframe.llm.common import stored

from . import awkward
from .test_block_naming import norm
from .test_decontaminate import brute as leaks
from .test_near_copies import least_ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(5).unionByName(spark.createDataFrame([(5000, None, None, None, None), (5001, "", "en", "s", 0), (5002, "123 456", None, "s", 7)], docs.schema))
    out = [docs.unionByName(extra)]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name))
    return out


def test_columns(stages):
    assert [s.schema for s in stages[1:-1]] == [stages[1].schema] * 4
    assert stages[1].columns == stages[0].columns


def test_language(stages):
    before, after = (Counter(map(tuple, s.collect())) for s in stages[:2])
    gone = before - after
    assert not after - before
    assert {r[0] for r in gone} >= {5000, 5001, 5002}
    assert all(r[2] is None or not any(map(str.isalpha, r[1] or "")) for r in gone)


def test_exact(stages):
    rows = stages[1].collect()
    best = defaultdict(int)
    for r in rows:
        best[norm(r.text)] = max(best[norm(r.text)], r.doc_id)
    got = stages[2].collect()
    assert Counter((r.doc_id, norm(r.text)) for r in got) == Counter((i, t) for t, i in best.items())


def test_near(stages):
    """Of each component of five-word Jaccard 0.8 or more, the least id stays."""
    rows = sorted((r.doc_id, r.text) for r in stages[2].collect())
    want, _ = least_ids(rows)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(set(want))


def test_near_by_simhash(spark):
    """Texts of one fingerprint but unlike five-word sets leave one row, as texts of like sets do."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(900)]
    # Each shingle of three words often enough for all bits, a tail of others for the sets.
    base = " ".join(words[:3] * 400)
    long = " ".join(words[100:300])
    texts = [base + " " + " ".join(r.sample(words, 12)) for _ in range(4)] + [long, long + " end"] + [" ".join(r.sample(words, 60)) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = [simhash_index.fingerprint(t.encode()) for t in texts]
    assert all((prints[0] ^ p).bit_count() <= 2 for p in prints[:4])
    want, _ = least_ids(list(enumerate(texts)))
    assert len(set(want[:4])) == 4
    got = corpus_pipeline.without_near_copies(spark, docs, SF).collect()
    assert sorted(g.doc_id for g in got) == [0, 4, *range(6, 11)]


def test_benchmark(spark, stages):
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = [r.doc_id for r in stages[3].collect() if not leaks(r.text, bench)[1]]
    assert sorted(r.doc_id for r in stages[4].collect()) == sorted(want)


def test_packed(stages):
    rows = stages[5].collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in stages[4].collect()}
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) <= -(-sum(fill.values()) // 1024) * 1.02 + 1


def test_run_and_awkward(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() > 0
    for docs in (awkward.docs(spark), awkward.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            names = docs.columns
            docs = stored(stage(spark, docs, SF), name)
            assert name == "best_fit_packing" or docs.columns == names
