"""Packed token matrices on disk: best-fit-decreasing with a segment tree over free capacities.

Each task encodes its documents, cuts those over ``width`` into pieces without losing an id, packs a
block of pieces into rows and writes the block as one file: the id matrix, the cumulative segment
lengths of each row and a bit per token that is set where positions start again.

At scale: blocks hold a bounded number of tokens, so a task's memory doesn't grow with its input and
no ids are shuffled. What a block leaves unfilled is at most a few rows of thousands. Files are
reported in a table of segments; a lost attempt's files are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from scoreframe.llm.common import shared_dir, stored
from scoreframe.llm.files import reading, writing
from scoreframe.llm.tokens import default_tokenizer, tokenizer

WIDTH, END_ID, PAD_ID = 1024, 2, 0
BLOCK_TOKENS = 4_000_000


class Capacities:
    """How many bins have each number of free tokens; finds the least one that suffices."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.bins: dict[int, list[int]] = {}

    def put(self, free: int, bin_: int) -> None:
        self.bins.setdefault(free, []).append(bin_)
        self._add(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A bin with the least free capacity of at least ``need``: (capacity, bin)."""
        i = need + self.leaves
        if not self.tree[i]:
            # Up to the first right neighbour that holds a bin, then down its left edge.
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        free = i - self.leaves
        self._add(free, -1)
        return free, self.bins[free].pop()

    def _add(self, free: int, n: int) -> None:
        i = free + self.leaves
        while i:
            self.tree[i] += n
            i >>= 1


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Indices of the pieces in each row, in the order they are placed."""
    free, rows = Capacities(width), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = free.take(lengths[k])
        if found is None:
            found = (width, len(rows))
            rows.append([])
        left, row = found
        rows[row].append(k)
        if left > lengths[k]:
            free.put(left - lengths[k], row)
    return rows


def _block(pieces: list[bytes], width: int, pad: int, kind: type) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Arrays of a file (matrix, row bounds, cumulative lengths, reset bits) and each piece's (row, offset)."""
    rows = best_fit_decreasing([len(p) // 4 for p in pieces], width)
    ids, resets = np.full((len(rows), width), pad, kind), np.zeros((len(rows), width), np.bool_)
    places, bounds, cumulative = [(0, 0)] * len(pieces), [0], []
    for r, row in enumerate(rows):
        at = 0
        cumulative.append(0)
        for k in row:
            part = np.frombuffer(pieces[k], "<u4")
            ids[r, at : at + len(part)] = part
            resets[r, at] = True
            places[k] = (r, at)
            at += len(part)
            cumulative.append(at)
        bounds.append(len(cumulative))
    arrays = [ids, np.array(bounds, "<i8"), np.array(cumulative, "<i4"), np.packbits(resets, axis=1)]
    return arrays, places


def write_matrices(
    docs: DataFrame, directory: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    tokenizer_path: str | None = None, width: int = WIDTH, end_id: int = END_ID, pad_id: int = PAD_ID,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Write the files; a row per piece: ``doc_id, piece, start, length, file, row, offset, sequence_id``.

    A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone. Ids are 16 bits
    wide if the vocabulary allows, else 32. Repeated rows and null ids are documents of their own;
    other columns are not read; an empty table writes nothing.
    """
    directory, path = directory or shared_dir(docs.sparkSession, "matrices"), tokenizer_path or default_tokenizer()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tok, end = TaskContext.get(), tokenizer(path), end_id.to_bytes(4, "little")
        kind = np.uint16 if max(tok.size, end_id, pad_id) <= 1 << 16 else np.uint32
        held: list[tuple] = []
        tokens = files = before = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, tokens, files, before
            file = f"{directory}/{task.partitionId():06d}-{task.taskAttemptId()}-{files:04d}.tok"
            arrays, places = _block([h[4] for h in held], width, pad_id, kind)
            with writing(file) as out:
                for a in arrays:
                    np.save(out, a, allow_pickle=False)
            first = (task.partitionId() << 36) + before
            columns = {
                "doc_id": pa.concat_arrays([h[0] for h in held]),
                "piece": pa.array([h[1] for h in held], pa.int32()),
                "start": pa.array([h[2] for h in held], pa.int64()),
                "length": pa.array([h[3] for h in held], pa.int64()),
                "file": pa.array([file] * len(held)),
                "row": pa.array([r for r, _ in places], pa.int32()),
                "offset": pa.array([o for _, o in places], pa.int64()),
                "sequence_id": pa.array([first + r for r, _ in places], pa.int64()),
            }
            held, tokens, files, before = [], 0, files + 1, before + len(arrays[0])
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            names = batch.column("doc_id")
            for i, text in enumerate(batch.column("text")):
                ids, name = tok.encode(text.as_py() or "") + end, names.slice(i, 1)
                for k, at in enumerate(range(0, len(ids) // 4, width)):
                    part = ids[4 * at : 4 * (at + width)]
                    held.append((name, k, at, len(part) // 4, part))
                    tokens += len(part) // 4
                    if tokens >= block_tokens:
                        yield flush()
        if held:
            yield flush()

    schema = f"doc_id {id_type}, piece int, start long, length long, file string, row int, offset long, sequence_id long"
    return stored(rows.mapInArrow(run, schema), "segments")


class _File:
    """A file's arrays, read once for all of its segments."""

    def __init__(self, path: str):
        self.path = path
        with reading(path) as stream:
            arrays = (np.lib.format.read_array(stream, allow_pickle=False) for _ in range(4))
            self.ids, self.bounds, self.cumulative, bits = arrays
        self.resets = np.unpackbits(bits, axis=1, count=self.ids.shape[1])

    def segment(self, row: int, start: int, end: int) -> tuple[int, int]:
        """Check sum of a segment's ids and the number of positions marked as starts in it."""
        cuts = self.cumulative[self.bounds[row] : self.bounds[row + 1]]
        k = int(np.searchsorted(cuts, start))
        if cuts[k] != start or cuts[k + 1] != end:
            raise ValueError(f"{self.path}: row {row} has no segment from {start} to {end}")
        return zlib.crc32(self.ids[row, start:end].astype("<u4").tobytes()), int(self.resets[row, start:end].sum())


def read_matrices(segments: DataFrame) -> DataFrame:
    """Read the segments back from their files: ``segments`` with ``ids_crc32`` and ``resets``.

    ``resets`` counts the positions of the segment that are marked as starts; it is 1 in a sound file. A
    segment the file doesn't have raises. Each file is read by the task that gets its segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        for batch in batches:
            crc, resets = [], []
            places = zip(*(batch.column(c).to_pylist() for c in ("file", "row", "offset", "length")), strict=True)
            for path, row, offset, length in places:
                if file is None or file.path != path:
                    file = _File(path)
                c, n = file.segment(row, offset, offset + length)
                crc.append(c)
                resets.append(n)
            columns = {n: batch.column(n) for n in names}
            yield pa.RecordBatch.from_pydict(columns | {"ids_crc32": pa.array(crc, pa.int64()), "resets": pa.array(resets, pa.int32())})

    names = segments.columns
    dealt = segments.repartition("file").sortWithinPartitions("file")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in segments.schema)
    return dealt.mapInArrow(run, f"{kinds}, ids_crc32 long, resets int")


def written(docs: DataFrame, **options) -> DataFrame:
    """Write and read back: a row per piece with its place and the check sum of the ids found there."""
    found = read_matrices(write_matrices(docs, **options))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "resets")
