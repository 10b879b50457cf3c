"""Quality scores by co-training: a text view and a metadata view teach each other.

Two classifiers see different things of a document: its words and shape, and its page metadata
(source, language, size, and the page's URL and size where there is a page of the same id). Over
several rounds each labels the unlabelled documents it is surest of, for the other to learn from.
Both are then calibrated on labelled documents that neither has seen, and their log odds are added.

At scale: every round scores all unlabelled documents, whole, in their tasks with broadcast weights.
A histogram over all of them says where a view's surest share begins; the share grows with the rounds.
Of the documents beyond it and of the labelled ones a bounded number, chosen by hashes, is fitted
(``LABELLED``, and ``TAUGHT`` per view and round; a row's text view has at most ``WORDS + 8`` entries). Only ids,
metadata and one number per document meet the page table in a shuffle, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.llm.common import LOWER_BYTES, stored, texts
from scoreframe.llm.decontaminate import word_hashes
from scoreframe.llm.linear import Sparse, ftrl, logits, temperature
from scoreframe.llm.url_rules import tokens as url_tokens

#: Rows that are fitted, at most: labelled ones, and qualified ones that a view teaches the other in a round.
LABELLED, TAUGHT = 4000, 3000
#: Rounds, and the share of all unlabelled documents that a view teaches in the first; round k takes k times that.
ROUNDS, TEACH = 3, 0.05
#: Steps of the histogram per unit of log odds, and where it ends.
STEPS, END = 16, 40
WORDS, SHAPES, META = 1 << 14, 64, 1 << 12
#: Byte classes whose shares describe a text's shape; fixed values.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"|", b"#$%&*+<=>@^_~{}[]\\/", b"\n", b".,;:", b" "]
_CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _k, _c in enumerate(CLASSES):
    _CLASS_OF[list(_c)] = _k


def text_view(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words (log counts, unit length) and eight steps for the share of each byte class."""
    h = word_hashes(text.translate(LOWER_BYTES))[2]
    idx, count = np.unique((h >> np.uint64(40)).astype(np.int64) & (WORDS - 1), return_counts=True)
    val = 1 + np.log(count)
    val /= max(np.sqrt(val @ val), 1e-12)
    sums = np.zeros(len(CLASSES) + 1)
    for at in range(0, len(text), 1 << 20):
        sums += np.bincount(_CLASS_OF[np.frombuffer(text[at : at + (1 << 20)], np.uint8)], minlength=len(CLASSES) + 1)
    step = np.minimum(np.sqrt(sums[:-1] / max(len(text), 1)) * 8, 7).astype(np.int64)
    shape = WORDS + 8 * np.arange(len(CLASSES)) + step
    return np.concatenate([idx, shape]), np.concatenate([val, np.full(len(shape), 0.5)])


_NOTHING = np.empty(0, np.int64), np.empty(0)


def meta_view(buckets: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    idx = np.unique(np.array(buckets or [], np.int64))
    return idx, np.full(len(idx), 1 / max(np.sqrt(len(idx)), 1))


def page_tokens(pages: DataFrame) -> DataFrame:
    """``_page, _page_tokens``: of several pages with one id, the tokens of the greatest url."""
    per_id = pages.groupBy(F.col("page_id").alias("_page")).agg(
        F.max(F.struct("url", F.length("html").alias("size"))).alias("p")
    )
    size = F.concat(F.lit("html:"), F.floor(F.log2(F.col("p.size") + 1)).cast("string"))
    return per_id.select("_page", F.array_compact(F.array_append(url_tokens(F.col("p.url")), size)).alias("_page_tokens"))


def _own_tokens(docs: DataFrame, text_col: str) -> Column:
    """Tokens of a row's own metadata; columns that aren't there give none."""
    parts = [
        F.concat(F.lit(f"{c}:"), docs[c].cast("string")) for c in ("source", "lang") if c in docs.columns
    ] + [F.concat(F.lit("chars:"), F.floor(F.log2(F.length(docs[text_col]) + 1)).cast("string"))]
    return F.array_compact(F.array(*parts))


def _buckets(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(META)).cast("int"))


@dataclass
class View:
    weights: np.ndarray
    bias: np.ndarray
    heat: float = 1.0

    def odds(self, x: tuple[np.ndarray, np.ndarray]) -> float:
        idx, val = x
        z = val @ self.weights[idx] + self.bias
        return float(z[1] - z[0]) / self.heat


@dataclass
class Model:
    text: View
    meta: View
    prior: float

    def score(self, text_odds: Column, meta_odds: Column) -> Column:
        """Both views' calibrated log odds, the prior that both hold counted once."""
        return sigmoid(text_odds + meta_odds - self.prior)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _fit(x: Sparse, y: np.ndarray, share: np.ndarray, dims: int) -> View:
    w, bias = ftrl(x, y, dims, 2, weights=share, epochs=3, alpha=0.3)
    return View(w, bias)


def step(odds: Column) -> Column:
    return F.floor(F.greatest(F.least(odds, F.lit(END)), F.lit(-END)) * STEPS).cast("int")


def cut_offs(counts: dict[int, int], good_share: float, teach: float) -> tuple[int | None, int | None]:
    """The last step of a view's surest rejections and the first of its surest approvals.

    ``counts`` are all unlabelled documents by step. Both ends hold their part of the share ``teach``, in the
    proportion of the labels, in whole steps on their side of even odds; an end without rows is None.
    """
    n = max(int(sum(counts.values()) * teach), 2)
    good = max(round(n * good_share), 1)

    def walk(steps: list[int], most: int) -> int | None:
        at, seen = None, 0
        for k in steps:
            if seen >= most:
                break
            at, seen = k, seen + counts[k]
        return at

    low = walk(sorted(k for k in counts if k < 0), max(n - good, 1))
    return low, walk(sorted((k for k in counts if k >= 0), reverse=True), good)


def surest(pool: DataFrame, good_share: float, teach: float, most: int = TAUGHT) -> DataFrame:
    """``_id, rank, text_y, meta_y``: the labels that the text view and the meta view teach, null where a view teaches none.

    ``pool`` has ``_id, text_odds, meta_odds`` of all unlabelled documents. Of those that qualify, at
    most ``most`` per view are kept, by a hash, both classes in the proportion of the labels.
    """
    pool = pool.where("_id IS NOT NULL").withColumn("rank", F.xxhash64("_id"))
    views = ("text", "meta")
    table = reduce(DataFrame.unionByName, [pool.select(F.lit(v).alias("view"), step(F.col(f"{v}_odds")).alias("step")) for v in views])
    table = table.groupBy("view", "step").count().collect()
    taught = []
    for v in views:
        odds = F.col(f"{v}_odds")
        low, high = cut_offs({r["step"]: r["count"] for r in table if r["view"] == v}, good_share, teach)
        good = min(max(round(most * good_share), 1), most - 1)
        for y, end, beyond, n in ((0, low, (odds < 0) & (step(odds) <= F.lit(low)), most - good), (1, high, (odds > 0) & (step(odds) >= F.lit(high)), good)):
            if end is not None:
                taught.append(F.when(beyond, F.struct(F.lit(v).alias("view"), F.lit(y).alias("y"), F.lit(n).alias("n"))))
    kind = "array<struct<view:string,y:int,n:int>>"
    given = F.array_compact(F.array(*taught)) if taught else F.array()
    # Rows that share an id are one. Spark applies the limit in the map tasks too, so a class sends n rows per task.
    rows = pool.select("_id", "rank", F.inline(given.cast(kind))).groupBy("view", "y", "n", "_id", "rank").agg(F.lit(None))
    place = F.row_number().over(Window.partitionBy("view", "y").orderBy("rank", "_id"))
    rows = rows.withColumn("place", place).where(F.col("place") <= F.lit(most)).where("place <= n")
    labels = [F.max(F.when(F.col("view") == v, F.col("y"))).alias(f"{v}_y") for v in views]
    return rows.groupBy("_id", "rank").agg(*labels)


def _labelled(rows: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """A bounded number of labelled rows, by the order of a hash."""
    ids = rows.select("_id").join(known, "_id").groupBy("_id").agg(F.max("label").alias("label"))
    ids = ids.withColumn("rank", F.xxhash64("_id")).orderBy("rank", "_id").limit(most)
    return ids.select("_id", "rank", F.col("label").alias("text_y"), F.col("label").alias("meta_y"))


@dataclass
class Rows:
    """Fitting rows: both views, and the label each view gives or has (-1: none). Without the meta view's label the text view is empty."""

    text: Sparse
    meta: Sparse
    text_y: np.ndarray
    meta_y: np.ndarray


def gather(rows: DataFrame, extra: DataFrame, chosen: DataFrame) -> Rows:
    """Both views of a bounded number of rows, in the order of their ranks; of rows that share an id one is used."""
    chosen = stored(chosen, "chosen")
    picked = rows.join(F.broadcast(chosen), "_id").select("_id", "rank", "text_y", "meta_y", _buckets(F.col("own")).alias("meta"), "text")
    names = ["_id", "rank", "text_y", "meta_y", "meta"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The text view learns from the meta view's labels; other rows need no text here.
            wanted = batch.column("meta_y").is_valid().to_pylist()
            found = [text_view(t) if w else _NOTHING for t, w in zip(texts(batch.column("text")), wanted, strict=True)]
            idx = pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary())
            val = pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), idx, val], [*names, "idx", "val"])

    kind = picked.schema["_id"].dataType.simpleString()
    views = picked.mapInArrow(run, f"_id {kind}, rank long, text_y int, meta_y int, meta array<int>, idx binary, val binary")
    one = views.groupBy("_id").agg(F.min(F.struct("rank", "text_y", "meta_y", "meta", "idx", "val")).alias("v"))
    pages = extra.join(F.broadcast(chosen.select(F.col("_id").alias("_page"), "rank")), "_page")
    page_of = {r["rank"]: r["b"] for r in pages.select("rank", _buckets(F.col("_page_tokens")).alias("b")).collect()}
    ys, ptr, idx, val, meta = ([], []), [0], bytearray(), bytearray(), []
    # One part of the rows at a time, so that the driver holds them once.
    for r in one.select("v.*").orderBy("rank").toLocalIterator():
        idx += r["idx"]
        val += r["val"]
        ptr.append(len(idx) // 4)
        meta.append(meta_view([*r["meta"], *page_of.get(r["rank"], [])]))
        for y, c in zip(ys, ("text_y", "meta_y"), strict=True):
            y.append(-1 if r[c] is None else r[c])
    text = Sparse(np.array(ptr), np.frombuffer(idx, "<i4"), np.frombuffer(val, "<f4"))
    return Rows(text, Sparse.of(meta), *[np.array(y, np.int64) for y in ys])


def fit_views(known: Rows, aside: np.ndarray, taught: Rows | None) -> tuple[View, View]:
    """Each view on the labelled rows not set aside and on what the other one taught, which counts less."""
    own, fitted = np.flatnonzero(~aside), []
    for x, y, more, lessons, dims in (
        (known.text, known.text_y, taught and taught.text, taught and taught.meta_y, WORDS + SHAPES),
        (known.meta, known.meta_y, taught and taught.meta, taught and taught.text_y, META),
    ):
        rows, label, share = x.take(own), y[own], np.ones(len(own))
        if taught is not None:
            given = np.flatnonzero(lessons >= 0)
            rows = Sparse.of([rows.row(k) for k in range(len(rows))] + [more.row(k) for k in given.tolist()])
            label, share = np.concatenate([label, lessons[given]]), np.concatenate([share, np.full(len(given), 0.3)])
        fitted.append(_fit(rows, label, share, dims))
    return fitted[0], fitted[1]


def both_odds(
    rows: DataFrame, extra: DataFrame, views: tuple[View, View] | None, known: DataFrame | None = None
) -> DataFrame:
    """``_id, text_odds, meta_odds`` of every row of whole texts; without views all are even.

    Rows whose ``_id`` is in ``known`` are left out, once their texts have become a number: so that join, however
    Spark does it, moves no text.
    """
    shared = rows.sparkSession.sparkContext.broadcast(views)
    kind = rows.schema["_id"].dataType.simpleString()

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = shared.value
            odds = [v[0].odds(text_view(t)) if v else 0.0 for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("own"), pa.array(odds, pa.float64())], ["_id", "own", "text_odds"]
            )

    def by_meta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = shared.value
            odds = [v[1].odds(meta_view(b)) if v else 0.0 for b in batch.column("meta").to_pylist()]
            columns = [batch.column("_id"), batch.column("text_odds"), pa.array(odds, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "text_odds", "meta_odds"])

    scored = rows.mapInArrow(by_text, f"_id {kind}, own array<string>, text_odds double")
    if known is not None:
        scored = scored.join(known, "_id", "left_anti")
    both = _buckets(F.concat("own", F.coalesce("_page_tokens", F.array().cast("array<string>"))))
    joined = scored.join(extra, scored["_id"] == extra["_page"], "left").select("_id", "text_odds", both.alias("meta"))
    return joined.mapInArrow(by_meta, f"_id {kind}, text_odds double, meta_odds double")


def cotrain(
    rows: DataFrame, extra: DataFrame, labels: DataFrame, rounds: int = ROUNDS, teach: float = TEACH,
    labelled: int = LABELLED, taught: int = TAUGHT,
) -> Model | None:
    """Fitted and calibrated views; None without labels of both classes. ``rows`` has ``_id, own, text``."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id"))
    known = known.agg(F.max("quality").cast("int").alias("label"))
    own = gather(rows, extra, _labelled(rows, known, labelled))
    if len({*own.text_y.tolist()}) < 2:
        return None
    aside = np.arange(1, len(own.text_y) + 1) % 5 == 0
    left = own.text_y[~aside]
    good = float(np.clip(left.mean(), 0.01, 0.99))
    views = fit_views(own, aside, None)
    for k in range(rounds):
        pool = stored(both_odds(rows, extra, views, known), "pool")
        views = fit_views(own, aside, gather(rows, extra, surest(pool, good, min(teach * (k + 1), 0.5), taught)))
    test = np.flatnonzero(aside)
    for x, view in zip((own.text, own.meta), views, strict=True):
        view.heat = temperature(logits(x.take(test), view.weights, view.bias), own.text_y[test])
    return Model(*views, float(np.log(good / (1 - good))))


def score(
    docs: DataFrame, labels: DataFrame, pages: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    rounds: int = ROUNDS, labelled: int = LABELLED, taught: int = TAUGHT,
) -> DataFrame:
    """One row per document: ``doc_id, score_text, score_meta, score, keep`` (score of 0.5 or more).

    Null and empty texts have the text view's bias only; rows without a page have their own metadata;
    null ids have no page. Without labels of both classes every score is 0.5 and all are kept.
    Repeated rows get equal scores; other columns are not read.
    """
    rows = docs.select(
        docs[id_col].alias("_id"), _own_tokens(docs, text_col).alias("own"), docs[text_col].cast("string").alias("text")
    )
    extra = stored(page_tokens(pages), "page_meta")
    model = cotrain(rows, extra, labels, rounds, TEACH, labelled, taught)
    odds = both_odds(rows, extra, (model.text, model.meta) if model else None)
    text, meta = F.col("text_odds"), F.col("meta_odds")
    total = model.score(text, meta) if model else F.lit(0.5)
    out = odds.select(F.col("_id").alias("doc_id"), sigmoid(text).alias("score_text"), sigmoid(meta).alias("score_meta"), total.alias("score"))
    return out.withColumn("keep", F.col("score") >= 0.5)
