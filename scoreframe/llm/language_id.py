"""Language identification: TF-IDF of hashed character n-grams into sparse multinomial logistic regression.

Training uses follow-the-regularised-leader with elastic-net penalties; the scores are then
calibrated by a temperature on rows kept out of the fit.

At scale: document frequencies come from all documents to learn from, as one vector of ``DIMS``
counts per task; the weights are fitted on at most ``sample_rows`` documents, taken evenly over the
languages by a hash; every text is then scored whole, in its task, with a broadcast table of
``DIMS`` x languages weights. No text is shuffled. A text over a million characters is counted in
segments that end at a space.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.linear import Sparse, ftrl, logits, softmax, temperature

DIMS = 1 << 14
#: Documents the weights are fitted on, at most, all languages together.
SAMPLE_ROWS = 3000
SEGMENT = 1 << 20
UNKNOWN = "und"
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; made once per worker."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000))
    return _LETTER[0]


def _count(text: str, dims: int) -> np.ndarray:
    cp = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)
    cp = np.where(_letters()[cp], cp, np.uint32(32))
    gap = cp == 32
    cp = cp[~(gap & np.r_[False, gap[:-1]])]
    out = np.zeros(dims, np.int64)
    h = np.zeros(len(cp), np.uint32)
    for n in range(1, 4):
        h = (h[: len(cp) - n + 1] + cp[n - 1 :]) * _MIX[n - 1]
        out += np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(dims - 1), minlength=dims)
    return out


def ngrams(text: str | None, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the 1- to 3-grams of a text; empty if it has no letter.

    Other characters than letters count as one space between words.
    """
    text = text or ""
    total, at, found = np.zeros(dims, np.int64), 0, False
    while at < len(text):
        stop = at + SEGMENT
        if stop < len(text):
            space = text.find(" ", stop)
            stop = space + 1 if space >= 0 else len(text)
        part = text[at:stop].lower()
        if any(map(str.isalpha, part)):
            found = True
            total += _count(part, dims)
        at = stop
    idx = np.flatnonzero(total) if found else np.empty(0, np.int64)
    return idx, total[idx]


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    heat: float

    def features(self, idx: np.ndarray, count: np.ndarray) -> np.ndarray:
        val = (1 + np.log(count)) * self.idf[idx]
        return val / max(np.sqrt(val @ val), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        idx, count = ngrams(text, len(self.idf))
        if not len(idx) or not self.classes:
            return UNKNOWN, 0.0
        p = softmax((self.features(idx, count) @ self.weights[idx] + self.bias) / self.heat)
        best = int(p.argmax())
        return self.classes[best], float(p[best])


def held_out(id_col: Column) -> Column:
    """A quarter of all ids by their check sum; null ids are not held out."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def _frequencies(rows: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Texts with letters, and in how many of them each bucket occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dims + 1, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                idx, _ = ngrams(text.as_py(), dims)
                df[idx] += 1
                n += bool(len(idx))
        df[dims] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["bucket", "n"])

    got = rows.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(dims + 1, np.int64)
    for r in got:
        df[r["bucket"]] = r["n"]
    return int(df[dims]), df[:dims]


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<i4").tobytes(), 1)


def _unpacked(row) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a sampled text."""
    gaps, count = (np.frombuffer(zlib.decompress(row[c]), "<i4") for c in ("idx", "count"))
    return np.cumsum(gaps, dtype=np.int64), count


def _tie(idx: np.ndarray, count: np.ndarray) -> int:
    """What ``xxhash64`` gives for the two as binaries, which settles equal ranks."""
    seed = xxhash.xxh64_intdigest(idx.astype("<i4").tobytes(), 42)
    return xxhash.xxh64_intdigest(count.astype("<i4").tobytes(), seed)


def _sample(rows: DataFrame, dims: int, most: int) -> list:
    """Counted n-grams of at most ``most`` different texts, as even over the labels as they allow.

    The driver gets them packed (``idx`` as gaps between buckets), ``n`` buckets each; :func:`_unpacked` reads a row.
    """
    # Copies count once: a text that very many rows repeat must not crowd out its language.
    distinct = F.approx_count_distinct(F.xxhash64("text")).alias("n")
    common = rows.where("text IS NOT NULL").groupBy("label").agg(distinct).orderBy(F.desc("n"), "label").limit(most)
    sizes = {r["label"]: r["n"] for r in common.collect()}
    if not sizes:
        return []
    each = max(most // len(sizes), 1)
    # Twice the share is counted, so that texts without letters leave enough; hashes decide, not places.
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, 2 * each / n))])
    rank = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    chosen = rows.withColumn("rank", rank).where(F.col("rank") < share[F.col("label")] * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngrams(t.as_py(), dims) for t in batch.column("text")]
            columns = {
                "label": batch.column("label"), "rank": batch.column("rank"),
                "tie": pa.array(np.array([_tie(*f) for f in found], np.uint64).view(np.int64)),
                "n": pa.array([len(i) for i, _ in found], pa.int32()),
                "idx": pa.array([_packed(np.diff(i, prepend=0)) for i, _ in found], pa.binary()),
                "count": pa.array([_packed(c) for _, c in found], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    counted = chosen.select("label", "rank", "text")
    counted = counted.mapInArrow(run, "label string, rank long, tie long, n int, idx binary, count binary").where("n > 0")
    parts = [F.first(c).alias(c) for c in ("n", "idx", "count")]
    counted = counted.groupBy("label", "rank", "tie").agg(*parts)
    place = F.expr("row_number() OVER (PARTITION BY label ORDER BY rank, tie)")
    counted = counted.withColumn("place", place).where(F.col("place") <= each)
    return counted.orderBy("place", "label", "rank", "tie").limit(most).collect()


def train(
    docs: DataFrame, learn: Column, text_col: str = "text", label_col: str = "lang",
    dims: int = DIMS, sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Fit on the rows where ``learn`` holds and the label isn't null; hashes of the texts pick the sample.

    Without such rows the model knows no class and predicts ``und``.
    """
    rows = docs.where(learn & docs[label_col].isNotNull()).select(
        docs[text_col].cast("string").alias("text"), docs[label_col].cast("string").alias("label")
    )
    sample = _sample(rows, dims, sample_rows)
    if not sample:
        return Model([], np.ones(dims), np.zeros((dims, 0), np.float32), np.zeros(0), 1.0)
    n, df = _frequencies(rows, dims)
    classes = sorted({r["label"] for r in sample})
    model = Model(classes, np.log((1 + n) / (1 + df)) + 1, np.zeros((dims, len(classes)), np.float32), np.zeros(len(classes)), 1.0)
    y = np.array([classes.index(r["label"]) for r in sample])
    # Every fifth row of each language calibrates.
    aside = np.array([r["place"] % 5 == 0 for r in sample])

    def features(which: np.ndarray) -> Sparse:
        values = ((idx, model.features(idx, count)) for idx, count in (_unpacked(sample[k]) for k in which.tolist()))
        return Sparse.filled(values, [sample[k]["n"] for k in which.tolist()])

    fit, test = np.flatnonzero(~aside), np.flatnonzero(aside)
    model.weights, model.bias = ftrl(features(fit), y[fit], dims, len(classes))
    model.heat = temperature(logits(features(test), model.weights, model.bias), y[test])
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (struct of the columns in ``carry``, all by default), ``lang_pred`` and ``score`` (0 to 1).

    Null texts and those without a letter are ``und`` with score 0; whole texts of any length are
    read; repeated rows get equal results.
    """
    names = docs.columns if carry is None else carry
    at = names.index(text_col) if text_col in names else None
    text = docs[text_col].cast("string") if at is None else F.lit(None).cast("string")
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), text.alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("row").field(at) if at is not None else batch.column("text")
            found = [shared.value.predict(t.as_py()) for t in column]
            lang, score = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), lang, score], ["row", "lang_pred", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


#: Below this calibrated probability a document's language counts as unknown.
MIN_SCORE = 0.5


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose language the model tells with at least ``min_score``, with all their columns."""
    found = predict(docs, model, text_col)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")
