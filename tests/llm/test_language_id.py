import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from scoreframe.llm import language_id
from scoreframe.llm.linear import Sparse, ftrl, logits, softmax, temperature

from . import awkward

VOCAB = {"aa": ["kato", "mira", "tolun", "peska"], "bb": ["schuh", "grüne", "weiß", "straße"], "cc": ["le", "château", "être", "çela"]}


def table(n=300):
    r = random.Random(4)
    out = []
    for k in range(n):
        lang = r.choice(list(VOCAB))
        out.append((k, " ".join(r.choice(VOCAB[lang]) for _ in range(r.randint(1, 30))), lang))
    return out


def test_held_out_accuracy(spark):
    rows = table()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.train(docs, ~language_id.held_out(F.col("doc_id")))
    assert model.classes == sorted(VOCAB)
    found = language_id.predict(docs, model).select("row.*", "lang_pred", "score", language_id.held_out(F.col("row.doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    test = [r for r in found if r.h]
    assert len(test) > 30 and np.mean([r.lang == r.lang_pred for r in test]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_awkward(spark):
    docs = awkward.docs(spark)
    model = language_id.train(docs, ~language_id.held_out(F.col("doc_id")))
    found = language_id.predict(docs, model)
    for r in found.collect():
        letters = any(map(str.isalpha, r.row.text or ""))
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    kept = language_id.keep_known(docs, model, min_score=0.0)
    assert kept.schema == docs.schema
    assert kept.count() == sum(any(map(str.isalpha, r[1] or "")) for r in awkward.rows())
    none = language_id.train(awkward.empty(spark), F.lit(True))
    assert none.classes == [] and {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(awkward.empty(spark), model).count() == 0


def test_sample_is_bounded_with_a_hot_row(spark):
    rows = [(1, "kato mira", "aa")] * 200 + table(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id._sample(docs.selectExpr("text", "lang AS label"), 256, 30)
    assert 0 < len(got) <= 30 and {r["label"] for r in got} == set(VOCAB)
    assert len({(r["idx"], r["count"]) for r in got}) == len(got)


def test_sample_is_packed(spark):
    """The driver gets a fraction of the eight bytes a bucket and count; ties stay those of the unpacked binaries."""
    rows = table(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id._sample(docs.selectExpr("text", "lang AS label"), 256, 30)
    known = {tuple(map(bytes, language_id.ngrams(t, 256))) for _, t, _ in rows}
    assert {tuple(v.astype(np.int64).tobytes() for v in language_id._unpacked(r)) for r in got} <= known
    long = " ".join(f"{t} {k}" for k, t, _ in rows)
    one = language_id._sample(spark.createDataFrame([(long, "aa")], "text string, label string"), 1 << 14, 30)[0]
    idx, count = language_id.ngrams(long)
    assert one["n"] == len(idx) and len(one["idx"]) + len(one["count"]) < 8 * len(idx) / 2
    raw = spark.createDataFrame([(idx.astype("<i4").tobytes(), count.astype("<i4").tobytes())], "i binary, c binary")
    assert one["tie"] == raw.select(F.xxhash64("i", "c")).first()[0]


def test_ngrams_by_hand():
    idx, count = language_id.ngrams("ab, ab")
    # " ab ab ": 7 single characters, 6 pairs, 5 triples.
    assert count.sum() == 18
    same = language_id.ngrams("AB 12 ab!")
    assert (same[0] == idx).all() and (same[1] == count).all()


def test_long_text_in_segments(monkeypatch):
    text = " ".join(random.Random(1).choice(VOCAB["bb"]) for _ in range(4000))
    whole = language_id.ngrams(text)
    monkeypatch.setattr(language_id, "SEGMENT", 500)
    cut = language_id.ngrams(text)
    assert abs(whole[1].sum() - cut[1].sum()) < 0.02 * whole[1].sum()


def test_ftrl_is_sparse_and_calibrated():
    r = np.random.default_rng(0)
    y = r.integers(0, 3, 600)
    rows = [(np.unique(np.r_[y[k], r.integers(3, 60, 5)]), None) for k in range(600)]
    x = Sparse.of([(i, np.ones(len(i))) for i, _ in rows])
    w, bias = ftrl(x, y, 60, 3, l1=2.0)
    p = softmax(logits(x, w, bias))
    assert (p.argmax(axis=1) == y).mean() > 0.98
    assert (w[3:] == 0).mean() > 0.5
    hot = logits(x, w, bias) * 10
    assert temperature(hot, y) > 0 and abs(temperature(hot * 2, y) / temperature(hot, y) - 2) < 0.1
