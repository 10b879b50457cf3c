import random
from collections import defaultdict

import corpus_pipeline
from scoreframe.llm import near_copies

from . import awkward
from .test_block_naming import AZ


def brute_set(text):
    words = (text or "").translate(AZ).encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def least_ids(rows):
    """Least id per component of pairs with Jaccard 0.8 or more; the number of such pairs of different sets."""
    sets = [brute_set(t) for _, t in rows]
    root, pairs = list(range(len(rows))), 0

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or 9 * both >= 4 * (len(a) + len(sets[j])) and both:
                root[max(top(i), top(j))] = min(top(i), top(j))
                pairs += a != sets[j]
    low = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[top(k)].append(i)
    return [min(low[top(k)], default=None) for k in range(len(rows))], pairs


def near_rows():
    """Originals with copies of a few changed words, some beside the limit, and a group of many."""
    r = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for k in range(60):
        base = [r.choice(words) for _ in range(r.choice([4, 30, 100, 400]))]
        texts.append(" ".join(base))
        for _ in range(60 if k == 7 else 3):
            copy = list(base)
            for _ in range(r.randint(1, max(len(base) // 35, 1))):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    r.shuffle(texts)
    return list(enumerate(texts))


def check(spark, rows, docs):
    want, pairs = least_ids(rows)
    got = near_copies.near_copies(docs).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or 0)
    assert sorted(((g.doc_id, g.component_id) for g in got), key=key) == sorted(((i, w) for (i, _), w in zip(rows, want, strict=True)), key=key)
    return pairs


def test_against_all_pairs(spark):
    rows = near_rows()
    assert check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) > 100


def test_stage_drops_copies_of_many_bits(spark):
    """Pairs of similarity 0.8 and more, which differ in more than two bits of their fingerprints."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, pairs = least_ids(rows)
    assert pairs
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(want))


def test_lists_in_files(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "IN_MEMORY", 100)
    monkeypatch.setattr(near_copies, "AT_ONCE", 50)
    rows = [(i, brute_set(t)) for i, t in near_rows() if t]
    some = near_copies._List()
    sets = sorted(((near_copies.shingles(t.encode()), i) for i, t in near_rows()), key=lambda x: len(x[0]))
    for h, i in sets:
        some.add(i, h.tobytes())
    want, _ = least_ids(near_rows())
    root = {i: i for i, _ in rows}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in some.links():
        assert top(a) != top(b)
        root[max(top(a), top(b))] = min(top(a), top(b))
    assert [top(i) for i, _ in near_rows()] == want


def test_awkward(spark):
    docs = awkward.docs(spark)
    check(spark, [r[:2] for r in awkward.rows()], docs)
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < len(awkward.rows())
    assert near_copies.drop_near_copies(awkward.empty(spark)).count() == 0
