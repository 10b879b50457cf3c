"""Packing into as few sequences as possible: best fit on counts, then swaps that empty bins.

Documents of one length are interchangeable, so the packing works on the number of pieces of each
length (at most ``width`` numbers, however large the corpus) and yields patterns: which lengths share
a bin, and how many bins are filled that way. A local search then takes the emptiest bins as donors
and exchanges one document for one, two for one, one for two, or moves one, whenever that raises the
sum of squared fills, for all bins of two patterns at once, until bins empty and none can improve.

At scale: a task counts its pieces of each length as it tokenises; the numbers of a piece within its
length come from those counts, so nothing is sorted and no length, however common, meets in one
task. Each piece then looks its place up in the slots of the patterns. Their number doesn't grow with
the corpus: best fit leaves at most three new patterns for each length.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.llm.common import stored
from scoreframe.llm.tokens import default_tokenizer, tokenizer

WIDTH, END_ID = 1024, 2
#: A bin's content: lengths, largest first.
Pattern = tuple[int, ...]


def best_fit(counts: dict[int, int], width: int) -> Counter[Pattern]:
    """Best-fit-decreasing on numbers of pieces per length: bins per pattern."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    free = 0  # bit r: there are bins with r tokens left

    def put(pattern: Pattern, left: int, bins: int) -> None:
        nonlocal free
        if bins:
            open_bins[left].append((pattern, bins))
            free |= 1 << left

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            fitting = free >> length
            if fitting:
                left = length + (fitting & -fitting).bit_length() - 1
                pattern, bins = open_bins[left].pop()
                if not open_bins[left]:
                    free ^= 1 << left
            else:
                left, pattern, bins = width, (), -(-todo // (width // length))
            each = left // length
            whole = min(bins, todo // each)
            put((*pattern, *[length] * each), left - each * length, whole)
            todo -= whole * each
            bins -= whole
            if bins and todo < each:
                put((*pattern, *[length] * todo), left - todo * length, int(todo > 0))
                bins -= todo > 0
                todo = 0
            put(pattern, left, bins if pattern else 0)
    out: Counter[Pattern] = Counter()
    for groups in open_bins.values():
        for pattern, bins in groups:
            out[pattern] += bins
    return out


def _takes(pattern: Pattern, pairs: bool = True) -> dict[int, Pattern]:
    """Sums of one or two documents of a bin, with the documents."""
    out = {a: (a,) for a in set(pattern)}
    if pairs:
        for a, b in combinations(sorted(set(pattern)), 2):
            out.setdefault(a + b, (b, a))
        for a, n in Counter(pattern).items():
            if n > 1:
                out.setdefault(2 * a, (a, a))
    return out


def _without(pattern: Pattern, gone: Pattern, more: Pattern) -> Pattern:
    rest = Counter(pattern) - Counter(gone) + Counter(more)
    return tuple(sorted(rest.elements(), reverse=True))


class _Bins:
    """Underfull bins by what can be taken out of them."""

    def __init__(self, bins: Counter[Pattern], width: int):
        self.width, self.bins, self.by_take = width, Counter(), defaultdict(dict)
        for pattern, n in bins.items():
            self.add(pattern, n)

    def add(self, pattern: Pattern, n: int) -> None:
        if pattern and n > 0:
            if pattern not in self.bins and sum(pattern) < self.width:
                for total, docs in self._offers(pattern):
                    self.by_take[total][pattern] = docs
            self.bins[pattern] += n

    def drop(self, pattern: Pattern, n: int) -> None:
        self.bins[pattern] -= n
        if not self.bins[pattern]:
            del self.bins[pattern]
            if sum(pattern) < self.width:
                for total, _ in self._offers(pattern):
                    del self.by_take[total][pattern]

    def _offers(self, pattern: Pattern):
        return [(0, ()), *_takes(pattern).items()]

    def exchange(self, donor: Pattern) -> tuple[Pattern, Pattern, Pattern] | None:
        """The fuller bin, what it gives and what it gets, that gains most from ``donor``; None if none gains."""
        fill, best = sum(donor), (0, None)
        for total, docs in sorted(_takes(donor).items(), reverse=True):
            for back in range(max(0, total - (self.width - fill)), total):
                gain = total - back
                if gain <= best[0]:
                    break
                for other, given in self.by_take.get(back, {}).items():
                    # Never two documents against two; the donor may be the pattern itself.
                    if len(docs) == len(given) == 2 or sum(other) < fill or sum(other) + gain > self.width:
                        continue
                    if other != donor or self.bins[donor] > 1:
                        best = (gain, (other, given, docs))
                        break
        return best[1]


def local_search(bins: Counter[Pattern], width: int) -> Counter[Pattern]:
    """Raise the sum of squared fills by exchanges until the bound is met or no exchange gains.

    Every exchange raises that sum, so the search ends. It works on patterns of bins, whose number depends
    on the lengths that occur and not on the corpus.
    """
    total = sum(sum(p) * n for p, n in bins.items())
    least = -(-total // width)
    state, count = _Bins(bins, width), sum(bins.values())
    gained = True
    while gained and count > least:
        gained = False
        heap = [(sum(p), p) for p in state.bins if sum(p) < width]
        heapify(heap)
        while heap and count > least:
            _, donor = heappop(heap)
            while state.bins[donor] and count > least and (found := state.exchange(donor)):
                other, given, got = found
                n = state.bins[donor] // 2 if other == donor else min(state.bins[donor], state.bins[other])
                state.drop(donor, n)
                state.drop(other, n)
                rest = _without(donor, got, given)
                state.add(rest, n)
                state.add(_without(other, given, got), n)
                count -= n * (not rest)
                gained = True
                if rest:
                    heappush(heap, (sum(rest), rest))
    return state.bins


def pieces(
    docs: DataFrame, id_col: str, text_col: str, path: str, width: int, end_id: int, with_ids: bool = False
) -> DataFrame:
    """One row per piece; ``part`` and ``nth`` number the pieces of a length within their task."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, seen, part = tokenizer(path), Counter(), TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            out = {k: [] for k in ("row", "piece", "start", "length", "ids_crc32", "nth", "ids")}
            for i, text in enumerate(batch.column("text")):
                ids = tok.encode(text.as_py() or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % width or width, n, width), n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    data = ids[4 * a : 4 * b]
                    values = (i, k, a, b - a, zlib.crc32(data), seen[b - a], data if with_ids else None)
                    for column, v in zip(out.values(), values, strict=True):
                        column.append(v)
                    seen[b - a] += 1
            row = pa.array(out.pop("row"), pa.int64())
            ids = pa.array(out.pop("ids"), pa.binary())
            columns = {"doc_id": batch.column("doc_id").take(row)}
            columns |= {k: pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()}
            yield pa.RecordBatch.from_pydict(columns | {"part": pa.array([part] * len(row), pa.int32()), "ids": ids})

    schema = "piece int, start long, length long, ids_crc32 long, nth long, part int, ids binary"
    return rows.mapInArrow(run, f"doc_id {kind}, {schema}")


def _slots(bins: Counter[Pattern]) -> dict[int, np.ndarray]:
    """Per length, columns (first number, first sequence, offset) sorted by number."""
    slots, used, first = defaultdict(list), Counter(), 0
    for pattern, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length in pattern:
            slots[length].append((used[length], first, offset))
            used[length] += n
            offset += length
        first += n
    return {k: np.array(v, np.int64).T for k, v in slots.items()}


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    width: int = WIDTH,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    A document is its ids and ``end_id``; only those over ``width`` are cut, the first piece being
    the shorter one. Null and empty texts are ``end_id`` alone. Repeated rows and null ids are
    documents of their own; other columns are not read; an empty table gives no pieces.
    """
    cut = pieces(docs, id_col, text_col, tokenizer_path or default_tokenizer(), width, end_id, with_ids)
    cut = stored(cut if with_ids else cut.drop("ids"), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    hist = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = docs.sparkSession.sparkContext.broadcast(_slots(local_search(best_fit(hist, width), width)))
    numbered = cut.join(bases, ["length", "part"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            sequence, offset = np.empty_like(number), np.empty_like(number)
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(bounds, bounds[1:], strict=False):
                at = order[a:b]
                starts, firsts, offsets = slots.value[int(length[at[0]])]
                slot = np.searchsorted(starts, number[at], side="right") - 1
                sequence[at] = firsts[slot] + number[at] - starts[slot]
                offset[at] = offsets[slot]
            columns = {n: batch.column(n) for n in names}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    numbered = numbered.select(*names, (F.col("base") + F.col("nth")).alias("number"))
    kinds = ", ".join(f"{n} {numbered.schema[n].dataType.simpleString()}" for n in names)
    return numbered.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def assemble(placed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` (binary), ``segments`` of pieces packed ``with_ids``; at most ``width`` ids per group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "piece", "length"))).alias("p")
    rows = placed.groupBy("sequence_id").agg(parts)
    ids = F.aggregate("p", F.lit("").cast("binary"), lambda s, p: F.concat(s, p["ids"]))
    cut = F.transform("p", lambda p: F.struct(p["offset"], p["length"], p["doc_id"], p["piece"]))
    return rows.select("sequence_id", ids.alias("ids"), cut.alias("segments"))
