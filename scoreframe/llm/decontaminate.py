"""Benchmark decontamination: a broadcast set of benchmark word windows against all document windows.

Benchmark items become distinct windows of ``n`` words (an item of fewer words is one window). Their
64-bit hashes go to the tasks as a broadcast set; each task hashes every window of its documents,
looks the hashes up and verifies the few hits word by word. The result needs no shuffle.

At scale: the set is broadcast in blocks of at most ``block_rows`` (window, item) rows. One block
holds some two million rows, far more than benchmark suites have; beyond that the documents pass
the next block, the marks of earlier ones travelling with them, so the bound drops nothing. A text
is hashed in segments: besides the text itself a task needs 8 bytes per word.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import LOWER_BYTES, lower_az, stored, texts

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Which bytes of lower-cased UTF-8 belong to words: digits, letters and all beyond ASCII.
IS_WORD = np.zeros(256, np.bool_)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
SEGMENT = 1 << 19
#: Odd multipliers; their powers make polynomial hashes over 2**64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MASK64 = (1 << 64) - 1
#: Size of the bit table that sorts out most windows before the exact search.
TABLE = 1 << 22


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(BYTE_BASE, SEGMENT + 1)
_DOWN = _powers(pow(BYTE_BASE, -1, 1 << 64), SEGMENT + 1)


def _segment_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of a lower-cased piece of text of at most SEGMENT bytes."""
    edge = np.diff(np.r_[False, IS_WORD[buf], False].view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _UP[: len(buf)], out=sums[1:])
    h = (sums[end] - sums[start]) * _DOWN[start]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return start, end, h ^ (h >> np.uint64(32))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (in bytes) and hash of each word of a lower-cased text of any length."""
    buf = np.frombuffer(text, np.uint8)
    parts, at = [], 0
    while at < len(buf):
        stop = min(at + SEGMENT, len(buf))
        if stop < len(buf):
            # Cut behind the last byte that belongs to no word; a longer word is hashed from its text.
            gaps = np.flatnonzero(~IS_WORD[buf[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:
                rest = np.flatnonzero(~IS_WORD[buf[stop:]])
                stop = stop + int(rest[0]) if len(rest) else len(buf)
                whole = hashlib.blake2b(buf[at:stop], digest_size=8).digest()
                parts.append((np.array([at]), np.array([stop]), np.frombuffer(whole, np.uint64)))
                at = stop
                continue
        start, end, h = _segment_words(buf[at:stop])
        parts.append((start + at, end + at, h))
        at = stop
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k, p in enumerate(_powers(WORD_BASE, n)):
        out += h[k : k + len(out)] * p
    return out ^ (out >> np.uint64(31))


class WindowSet:
    """One block of benchmark windows, ready for look-ups."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.items: dict[bytes, list[str]] = defaultdict(list)
        for window, item in rows:
            self.items[window.encode()].append(item)
        by_length = defaultdict(list)
        for w in self.items:
            h = word_hashes(w)[2]
            by_length[len(h)].append(int(_window_hashes(h, len(h))[0]))
        self.hashes = {n: np.unique(np.array(v, np.uint64)) for n, v in sorted(by_length.items())}

    def tables(self) -> dict[int, np.ndarray]:
        """Bit tables, made where they are used: they are large and cheap."""
        if not hasattr(self, "_tables"):
            self._tables = {}
            for n, v in self.hashes.items():
                bits = np.zeros(TABLE, np.bool_)
                bits[v & np.uint64(TABLE - 1)] = True
                self._tables[n] = bits
        return self._tables

    def hits(self, text: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray):
        """Verified windows of a text: (first word, words, items)."""
        for n, bits in self.tables().items():
            w = _window_hashes(h, n)
            at = np.flatnonzero(bits[w & np.uint64(TABLE - 1)])
            if not len(at):
                continue
            known = self.hashes[n]
            found = np.minimum(np.searchsorted(known, w[at]), len(known) - 1)
            for i in at[known[found] == w[at]].tolist():
                words = [text[s:e] for s, e in zip(start[i : i + n].tolist(), end[i : i + n].tolist(), strict=True)]
                if items := self.items.get(b" ".join(words)):
                    yield i, n, items


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = 10) -> DataFrame:
    """Distinct ``window, item`` rows; items without words (null too) have none."""
    words = benchmark.select(
        F.coalesce(benchmark[id_col].cast("string"), F.lit("")).alias("item"),
        F.regexp_extract_all(lower_az(benchmark[text_col]), F.lit(f"({WORD})"), 1).alias("words"),
    ).where("size(words) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0)))
    cut = F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, n), " "))
    return words.select(F.explode(cut).alias("window"), "item").distinct()


FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
MARKS = "marks binary, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans(mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[dict]:
    edge = np.diff(np.r_[False, mark, False].view(np.int8))
    firsts, lasts = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return [{"start": int(start[a]), "end": int(end[b])} for a, b in zip(firsts, lasts, strict=True)]


def _marked(batch: pa.RecordBatch, at: int | None, known: WindowSet | None) -> Iterator[tuple]:
    """Words, hit words, packed marks, items and spans of each text, earlier blocks' marks included."""
    column = batch.column("row").field(at) if at is not None else batch.column("text")
    before = zip(batch.column("marks").to_pylist(), batch.column("items").to_pylist(), strict=True)
    for text, (bits, seen) in zip(texts(column), before, strict=True):
        low = text.translate(LOWER_BYTES)
        start, end, h = word_hashes(low)
        mark = np.zeros(len(h), np.bool_)
        if bits:
            mark |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(h)).view(np.bool_)
        names = set(seen or ())
        for i, size, found in known.hits(low, start, end, h) if known else ():
            mark[i : i + size] = True
            names.update(found)
        packed = np.packbits(mark).tobytes() if names else None
        yield len(h), int(mark.sum()), packed, sorted(names), _spans(mark, start, end) if names else []


def annotate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    carry: list[str] | None = None,
    n: int = 10,
    item_id: str = "item_id",
    item_text: str = "text",
    block_rows: int = 2_000_000,
) -> DataFrame:
    """``row`` (struct of the columns in ``carry``, all by default), ``n_words``, ``n_hit``, ``items``, ``spans``.

    ``items`` are the sorted ids of items with a window in the text; ``spans`` are the merged hit
    stretches as byte offsets into the UTF-8 text. Null and empty texts have no words and no hits;
    repeated rows are judged one by one; an empty benchmark hits nothing; ids of items may be null
    (then an empty string) or repeat.
    """
    spark = docs.sparkSession
    names = docs.columns if carry is None else carry
    windows = stored(benchmark_windows(benchmark, item_id, item_text, n), "windows")
    blocks = max(-(-windows.count() // block_rows), 1)
    windows = windows.withColumn("block", F.pmod(F.xxhash64("window", "item"), F.lit(blocks)))
    at = names.index(text_col) if text_col in names else None
    text = docs[text_col].cast("string") if at is None else F.lit(None).cast("string")
    rows = docs.select(
        F.struct(*[docs[c] for c in names]).alias("row"), text.alias("text"),
        F.lit(None).cast("binary").alias("marks"), F.lit(None).cast("array<string>").alias("items"),
    )
    kind = f"row {rows.schema['row'].dataType.simpleString()}"

    def passing(known, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(_marked(batch, at, known.value))
                items = pa.array([f[3] for f in found], pa.list_(pa.string()))
                if last:
                    n_words = pa.array([f[0] for f in found], pa.int64())
                    n_hit = pa.array([f[1] for f in found], pa.int64())
                    spans = pa.array([f[4] for f in found], _SPANS)
                    columns = {"row": batch.column("row"), "n_words": n_words, "n_hit": n_hit, "items": items, "spans": spans}
                else:
                    marks = pa.array([f[2] for f in found], pa.binary())
                    columns = {"row": batch.column("row"), "text": batch.column("text"), "marks": marks, "items": items}
                yield pa.RecordBatch.from_pydict(columns)

        return run

    for k in range(blocks):
        if k:
            rows = stored(rows, "marked")
        block = WindowSet([tuple(r) for r in windows.where(F.col("block") == k).select("window", "item").collect()])
        known, last = spark.sparkContext.broadcast(block), k == blocks - 1
        rows = rows.mapInArrow(passing(known, last), f"{kind}, {FOUND}" if last else f"{kind}, text string, {MARKS}")
    return rows


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with all their columns."""
    return annotate(docs, benchmark, text_col, **options).where("n_hit = 0").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All rows; hit stretches are cut out of the texts, other columns are as they were."""
    found = annotate(docs, benchmark, text_col, **options)
    data = F.encode(F.col("row").getField(text_col), "UTF-8")
    start = F.struct(F.lit(1).alias("at"), F.lit("").cast("binary").alias("kept"))

    def cut(b):
        def step(state, s):
            piece = F.substring(b, state["at"], (s["start"] + 1 - state["at"]).cast("int"))
            return F.struct((s["end"] + 1).cast("int").alias("at"), F.concat(state["kept"], piece).alias("kept"))

        def finish(s):
            return F.concat(s["kept"], F.substring(b, s["at"], F.octet_length(b)))

        return F.decode(F.aggregate("spans", start, step, finish), "UTF-8")

    text = F.when(F.size("spans") > 0, F.transform(F.array(data), cut)[0]).otherwise(F.col("row").getField(text_col))
    columns = [text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return found.select(*columns)
