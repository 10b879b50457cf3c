import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scoreframe.llm import divergence
from scoreframe.llm.transducer import Builder, Transducer, build

from . import awkward

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=10, top=10):
    """The contract row by row; rows are (text, lang, source)."""
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(AZ))) for text, lang, source in rows]
    df, count = Counter(), defaultdict(Counter)
    for lang, source, words in docs:
        df.update((lang, w) for w in set(words))
        count[lang, source].update(words)
    kept = defaultdict(list)
    for (lang, w), n in df.items():
        if n >= min_docs:
            kept[lang].append(w)

    def shares(words, n):
        total = sum(n[w] for w in words) + 2 * len(words)
        return {w: 1 + 10**9 * (n[w] + 2) // total for w in words}

    def gap(p, q):
        return (p - q) ** 2 // (p + q)

    of_lang = defaultdict(Counter)
    for (lang, _), n in count.items():
        of_lang[lang].update(n)
    p = {g: shares(kept[g[0]], n) for g, n in count.items()}
    q = {lang: shares(kept[lang], n) for lang, n in of_lang.items()}
    out = []
    for lang, source in count:
        mine = p[lang, source]
        pairs = [(-sum(gap(mine[w], p[lang, s][w]) for w in mine), s.encode()) for a, s in count if a == lang and s != source]
        terms = [(-gap(mine[w], q[lang][w]), w.encode()) for w in mine if count[lang, source][w] and mine[w] > q[lang][w]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(items)]
    return Counter(out)


def check(spark, rows, **options):
    docs = spark.createDataFrame([(k, *r, 1, "x", "y") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, gid long, part string, ord string")
    got = divergence.audit(docs.repartition(3), **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == brute(rows, **options)


def texts(n, seed=1, sources=6, langs=("en", "fr", None)):
    r = random.Random(seed)
    words = ["The", "the", "été", "Été", "naïve", "日本", "🙂🙂", "a", "b'c", "x1y2", "Ωmega", "of", "AND", "zz_top", "é"]
    words += ["".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(200)]
    out = []
    for _ in range(n):
        k = r.randrange(sources)
        some = words[k * 5 : k * 5 + 60]
        out.append((" ".join(r.choice(some) for _ in range(r.randint(0, 40))), r.choice(langs), f"s{k}" if k else None))
    return out


def test_as_brute_force(spark):
    check(spark, texts(400))


@pytest.mark.parametrize("sizes", [(7, 200, 2, 5), (1, 1, 1, 1), (50, 1 << 20, 3, 16)])
def test_small_blocks_passes_and_tiles(spark, monkeypatch, sizes):
    """The same result through many transducers, passes, tiles and blocks of terms."""
    for name, n in zip(("BLOCK_TERMS", "PASS_BYTES", "TILE", "TERMS"), sizes, strict=True):
        monkeypatch.setattr(divergence, name, n)
    monkeypatch.setattr(divergence, "CHUNK", 300)
    monkeypatch.setattr(divergence, "HELD_TERMS", 100)
    monkeypatch.setattr(divergence, "HELD_COUNTS", 100)
    check(spark, texts(60 if sizes[0] == 1 else 200, seed=2), min_docs=20 if sizes[0] == 1 else 3)


def test_awkward_rows(spark):
    rows = [(r[1], r[2], r[3]) for r in awkward.rows()]
    rows += [("x" * 5000 + " the", "en", "s1")] * 12 + [("the of the", "en", "s1"), ("the of the", "en", "s9")] * 10
    rows += [("only here", "one", "alone")] * 11 + [(None, "none", "a"), ("", "none", "b"), ("12 34", "none", "")]
    check(spark, rows)
    check(spark, rows, min_docs=1, top=3)
    check(spark, rows, min_docs=10_000)


def test_ties_by_ordinal(spark):
    words = [f"t{chr(97 + k)}" for k in range(14)] + ["é", "z", "日"]
    check(spark, [(" ".join(words), "en", "a")] * 10 + [("other", "en", "b")] * 12)


def test_empty_table(spark):
    assert divergence.audit(awkward.empty(spark)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=5), max_size=40), st.lists(st.binary(max_size=6), max_size=20))
def test_transducer(terms, others):
    terms = sorted(set(terms))
    t = Transducer.load(build(terms).dump())
    assert list(t) == terms and t.size == len(terms)
    words = [*terms, *others]
    length = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(np.r_[0, length[:-1]]) if words else length
    # One more byte, so that a word at the end may look behind itself.
    found = t.ordinals(np.frombuffer(b"".join(words) + b"\0", np.uint8), start, length)
    assert found.tolist() == [terms.index(w) if w in terms else -1 for w in words]


def test_transducer_is_minimal():
    """Terms with the same ends share their states; no two states have the same right language."""
    t = build(sorted(a + b for a in (b"x", b"yy", b"zq") for b in (b"ing", b"ed", b"")))
    ends = defaultdict(set)
    for k in range(len(t.final)):
        edges = t.edges[t.edges[:, 0] == k]
        ends[(bool(t.final[k]), tuple(map(tuple, edges[:, 1:3])))].add(k)
    assert all(len(v) == 1 for v in ends.values())
    builder = Builder()
    builder.add(b"b")
    with pytest.raises(ValueError):
        builder.add(b"a")
