import random
from collections import Counter, defaultdict

import re
import xxhash

from scoreframe.llm import simhash_index
from scoreframe.llm import components as components_module
from scoreframe.llm.common import stored
from scoreframe.llm.components import components

from . import awkward
from .test_block_naming import AZ


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps):
    """Least id per component of fingerprints within two bits."""
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {f: top(f) for f in distinct}


def check(rows, got):
    fps = [brute_fp(t) for _, t in rows]
    top = brute_components(fps)
    low = defaultdict(list)
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            low[top[f]].append(i)
    want = Counter((i, f, min(low[top[f]], default=None)) for (i, _), f in zip(rows, fps, strict=True))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want


def test_against_brute_force(spark):
    rows = [r[:2] for r in awkward.rows()]
    check(rows, simhash_index.near_duplicates(awkward.docs(spark)).collect())


def test_links_by_brute_force(spark):
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(40)]
    fps = set(seeds)
    for s in seeds[:10]:
        for _ in range(60):  # long lists, chains of changed bits
            s ^= 1 << r.randrange(16)
            fps.add(s)
    for s in seeds[10:25]:
        fps.add(s ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash_index.links(spark.createDataFrame(signed, "fp long"))
    got = {r.node % (1 << 64): r.root for r in components(edges).collect()}
    want = brute_components(fps)
    groups = defaultdict(set)
    for f, top in want.items():
        groups[top].add(f)
    for g in groups.values():
        assert len({got.get(f, f) for f in g}) == 1
        assert len(g) == 1 or all(f in got for f in g)
    assert len(set(got.values())) == sum(len(g) > 1 for g in groups.values())


def test_steps_of_components(spark, monkeypatch):
    """No step over finished components, and each step's join is worked out once."""
    written = []
    monkeypatch.setattr(components_module, "stored", lambda df, label: written.append(label) or stored(df, label))
    stars = [(k, k % 5) for k in range(5, 60)] + [(7, 7)]
    got = {x.node: x.root for x in components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {k: k % 5 for k in range(60)} | {7: 2} and written == ["edges"]
    written.clear()
    path = [(k, k + 1) for k in range(0, 40)] + [(100, 50)]
    got = {x.node: x.root for x in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {50: 50, 100: 50}
    assert written == ["edges"] + ["large", "edges"] * (len(written) // 2) and len(written) <= 13


def test_components(spark):
    r = random.Random(9)
    edges = [(k, k + 1) for k in range(100, 140)] + [(1, 50), (50, 1), (2, 1), (7, 7), (None, 3), (60, 61)]
    edges += [(300, 300 + k) for k in range(1, 200)] + [(450, 301)]
    r.shuffle(edges)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(100, 141)} == {100}
    assert got[50] == got[2] == got[1] == 1 and got[7] == 7 and got[61] == 60 and 3 not in got
    assert {got[k] for k in range(300, 500)} == {300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_text_in_segments(monkeypatch):
    text = " ".join(random.Random(1).choice(["ab", "Cd", "é", "x1"]) for _ in range(5000))
    whole = simhash_index.fingerprint(text.encode())
    real = simhash_index.segments
    monkeypatch.setattr(simhash_index, "segments", lambda d, **k: real(d, 100, k["breaks"]))
    assert simhash_index.fingerprint(text.encode()) == whole == brute_fp(text)


def test_filter(spark):
    docs = awkward.docs(spark)
    kept = simhash_index.drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    got = [(r.doc_id, brute_fp(r.text)) for r in kept.collect()]
    tops = brute_components([brute_fp(r[1]) for r in awkward.rows()])
    assert Counter(tops[f] for _, f in got) == Counter(set(tops.values()))
    assert simhash_index.drop_near_duplicates(awkward.empty(spark)).count() == 0
