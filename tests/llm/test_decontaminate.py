import random
import re

import pytest

from scoreframe.llm import decontaminate

from . import awkward
from .test_block_naming import AZ

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(AZ))


def brute(text, bench, n=10):
    w, hit, items = words(text), set(), set()
    for item, t in bench:
        b = words(t)
        size = min(n, len(b))
        wins = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if b else set()
        for i in range(len(w) - size + 1) if b else ():
            if tuple(w[i : i + size]) in wins:
                hit.update(range(i, i + size))
                items.add(str(item) if item is not None else "")
    return len(w), len(hit), sorted(items)


def table():
    r = random.Random(2)
    vocab = [f"w{k}" for k in range(30)] + ["É", "日本", "Zz"]
    bench = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([3, 9, 10, 11, 25])))) for k in range(30)]
    bench += [(50, None), (51, ""), (52, "!!"), (3, bench[4][1]), (None, "lonely item"), (53, "solo")]
    docs = []
    for k in range(60):
        parts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 40)))]
        if k % 3 == 0:
            t = r.choice(bench[:30])[1]
            parts.append(re.sub(" ", r.choice([", ", "\n", " -- "]), t).upper() if k % 2 else t)
        docs.append((k, " ".join([*parts, "tail"])))
    docs += [(99, None), (98, ""), (97, "Solo"), (96, "a lonely item here"), (97, "Solo")]
    return docs, bench


@pytest.mark.parametrize("block_rows", [2_000_000, 60])
def test_against_brute_force(spark, block_rows):
    docs, bench = table()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = decontaminate.annotate(df, spark.createDataFrame(bench, "item_id long, text string"), block_rows=block_rows)
    got = sorted((r.row.doc_id, r.row.text or "", r.n_words, r.n_hit, r["items"]) for r in found.collect())
    assert got == sorted((i, t or "", *brute(t, bench)) for i, t in docs)


def test_spans_and_filters(spark):
    docs, bench = table()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    kept = decontaminate.drop_contaminated(df, b).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, t in docs if not brute(t, bench)[1])
    cut = {(r.doc_id, r.text) for r in decontaminate.remove_spans(df, b).collect()}
    by_id = dict(cut)
    for i, t in docs:
        n, hit, _ = brute(t, bench)
        assert len(words(by_id[i])) == n - hit
        assert hit or by_id[i] == t


def test_awkward(spark):
    _, bench = table()
    b = spark.createDataFrame(bench, "item_id long, text string")
    docs = awkward.docs(spark)
    got = decontaminate.annotate(docs, b)
    assert sorted(r.n_words for r in got.collect()) == sorted(len(words(r[1])) for r in awkward.rows())
    assert decontaminate.drop_contaminated(docs, b).schema == docs.schema
    assert decontaminate.drop_contaminated(docs, b.limit(0)).count() == len(awkward.rows())
    assert decontaminate.annotate(awkward.empty(spark), b).count() == 0


def test_words_across_segments(monkeypatch):
    text = " ".join(["abc", "d", "e" * 50] * 40).encode()
    _, _, whole = decontaminate.word_hashes(text)
    monkeypatch.setattr(decontaminate, "SEGMENT", 64)
    start, end, h = decontaminate.word_hashes(text)
    assert [text[a:b] for a, b in zip(start, end, strict=True)] == text.split()
    assert (h == whole).all()
