import random

import numpy as np
from pyspark.sql import functions as F

from scoreframe.llm import cotraining
from scoreframe.llm.linear import Sparse

from . import awkward


def test_scores(spark):
    r = random.Random(1)
    docs, labels, pages = [], [], []
    for k in range(400):
        good = r.random() < 0.7
        text = " ".join(r.choice(["calm", "plain", "prose", "words"] if good else ["BUY!!", "$$$", "now|", "WIN"]) for _ in range(30))
        docs.append((k, text, "en", "s1" if good else "s2", len(text)))
        pages.append((k, f"http://{'a' if good else 'b'}.org/x{k}", "h" * (50 if good else 5)))
        if k % 4 == 0:
            labels.append((k, int(good), 0))
    truth = {d[0]: "s1" == d[3] for d in docs}
    docs += [(None, None, None, None, None), (1000, "", None, None, None), docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = cotraining.score(
        df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), spark.createDataFrame(pages, "page_id long, url string, html string")
    ).collect()
    assert len(got) == len(docs)
    rest = [g for g in got if g.doc_id in truth and g.doc_id % 4]
    assert np.mean([g.keep == truth[g.doc_id] for g in rest]) > 0.95
    assert np.mean([(g.score_meta > 0.5) == truth[g.doc_id] for g in rest]) > 0.9
    assert all(0 <= g.score <= 1 for g in got)


def brute_cut_offs(odds, good_share, teach):
    """Rows beyond the cut-offs, from the sorted odds themselves."""
    n = max(int(len(odds) * teach), 2)
    good = max(round(n * good_share), 1)
    of = lambda z: int(np.floor(np.clip(z, -cotraining.END, cotraining.END) * cotraining.STEPS))
    low = sorted(z for z in odds if of(z) < 0)[: max(n - good, 1)]
    high = sorted((z for z in odds if of(z) >= 0), reverse=True)[:good]
    return (
        {k for k, z in enumerate(odds) if low and z < 0 and of(z) <= of(low[-1])},
        {k for k, z in enumerate(odds) if high and z > 0 and of(z) >= of(high[-1])},
    )


def test_surest_by_brute_force(spark):
    """Every unlabelled row has a say in the cut-offs; the bound holds only for what is fitted."""
    r = np.random.default_rng(5)
    text, meta = r.normal(0.5, 2, 900), np.round(r.normal(-1, 1, 900), 1)
    pool = spark.createDataFrame([(k, float(text[k]), float(meta[k])) for k in range(900)], "_id long, text_odds double, meta_odds double")
    for share, teach in ((0.7, 0.1), (0.1, 0.4), (0.5, 0.001)):
        got = cotraining.surest(pool.repartition(5), share, teach, 100_000).collect()
        for view, odds in (("text_y", text), ("meta_y", meta)):
            low, high = brute_cut_offs(odds.tolist(), share, teach)
            assert {g["_id"] for g in got if g[view] == 0} == low and {g["_id"] for g in got if g[view] == 1} == high
    some = cotraining.surest(pool, 0.7, 0.2, 20).collect()
    assert 20 <= len(some) <= 40
    assert sum(g.text_y == 1 for g in some) == 14 and sum(g.text_y == 0 for g in some) == 6
    one_sided = pool.select("_id", F.lit(0.0).alias("text_odds"), F.lit(3.0).alias("meta_odds"))
    assert {(g.text_y, g.meta_y) for g in cotraining.surest(one_sided, 0.5, 0.1, 50).collect()} == {(None, 1)}
    assert cotraining.surest(pool.limit(0), 0.5, 0.1).count() == 0


def test_one_round_by_hand():
    """Views learn from labelled rows that aren't set aside and from the other's lessons, not from their own."""
    text = Sparse.of([(np.array([k % 2]), np.ones(1)) for k in range(20)])
    meta = Sparse.of([(np.array([10 + k % 2]), np.ones(1)) for k in range(20)])
    y = np.arange(20) % 2
    known, aside = cotraining.Rows(text, meta, y, y), np.arange(20) >= 16
    text_lessons, meta_lessons = np.array([1, -1, 0]), np.array([-1, 0, 0])
    more = Sparse.of([(np.array([30 + k]), np.ones(1)) for k in range(3)])
    taught = cotraining.Rows(more, more, text_lessons, meta_lessons)
    views = cotraining.fit_views(known, aside, taught)
    # The text view is taught by the meta view's labels, with a weight of 0.3.
    for view, x, own, dims in ((views[0], text, meta_lessons, cotraining.WORDS + cotraining.SHAPES), (views[1], meta, text_lessons, cotraining.META)):
        rows = [x.row(k) for k in range(16)] + [more.row(k) for k in range(3) if own[k] >= 0]
        want = cotraining._fit(Sparse.of(rows), np.r_[y[:16], own[own >= 0]], np.r_[np.ones(16), np.full((own >= 0).sum(), 0.3)], dims)
        assert np.array_equal(view.weights, want.weights) and np.array_equal(view.bias, want.bias)
        # A row that only the other view didn't teach leaves no weight.
        assert all((np.abs(view.weights[30 + k]).max() > 0) <= (own[k] >= 0) for k in range(3))


def test_rounds_teach_the_weaker_view(spark):
    """Metadata too varied for the few labels is learnt from what the text view teaches."""
    r = random.Random(3)
    docs, labels, truth = [], [], {}
    for k in range(1200):
        truth[k] = r.random() < 0.5
        text = " ".join(r.choice(["calm", "plain"] if truth[k] else ["buy", "now"]) for _ in range(8))
        docs.append((k, text, f"s{2 * r.randrange(20) + truth[k]}"))
        if k < 40:
            labels.append((k, int(truth[k]), 0))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    right = []
    for rounds in (0, 3):
        got = cotraining.score(df, known, pages, rounds=rounds).collect()
        right.append(np.mean([(g.score_meta > 0.5) == truth[g.doc_id] for g in got if g.doc_id >= 40]))
    assert right[1] > 0.9 and right[1] > right[0] + 0.1


def test_awkward(spark):
    docs = awkward.docs(spark)
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(4, None, None), (4, "http://a.b/", "x"), (None, "http://c.d/", "y")], "page_id long, url string, html string")
    got = cotraining.score(docs, no_labels, pages).collect()
    assert len(got) == len(awkward.rows()) and {g.score for g in got} == {0.5} and all(g.keep for g in got)
    some = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (9, 1, 0), (20, 0, 1), (None, 1, 0), (21, None, 0)], "doc_id long, quality int, toxic int")
    assert cotraining.score(docs, some, pages).count() == len(awkward.rows())
    assert cotraining.score(awkward.empty(spark), some, pages).count() == 0


def test_unlabelled_pool_moves_no_text(spark, monkeypatch):
    """Labelled rows are left out behind the scoring: a join before it, when not broadcast, shuffles whole texts."""
    pools, keep = [], cotraining.stored

    def spy(df, label):
        out = keep(df, label)
        if label == "pool":
            pools.append((df._jdf.queryExecution().optimizedPlan().toString(), {r["_id"] for r in out.collect()}))
        return out

    monkeypatch.setattr(cotraining, "stored", spy)
    docs = spark.createDataFrame([(k, f"word{k % 7} text") for k in range(60)] + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert cotraining.score(docs, labels, pages).count() == 61
    assert len(pools) == cotraining.ROUNDS
    for plan, ids in pools:
        assert ids == {None, *range(20, 60)}
        assert plan.index("LeftAnti") < plan.rindex("MapInArrow")
