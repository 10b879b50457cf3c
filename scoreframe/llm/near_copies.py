"""Near copies by exact Jaccard similarity of word shingles; candidates from an index of MinHash bands.

A lower-cased text is the set of its five-word shingles, and two texts are linked exactly if those
sets' Jaccard similarity is ``LEAST`` or more. Fingerprints of two such texts differ in about ten of
64 bits, too many for an index on parts of them; here a text is posted under ``BANDS`` keys of
``DEPTH`` minima each. Sets of similarity s share a key with probability ``1 - (1 - s**DEPTH)**BANDS``:
over 0.99995 at 0.8, more above. Only pairs that share no key at all can be missed.

At scale: copies of one set are one node. Lists of the same nodes are one list, so a pair that meets
in ten lists is compared once. Sets are worked out again for nodes in a list of two or more only, and
one too large for memory lies in a temporary file while its list is compared. A list hands on a
spanning forest of its verified links, and pairs that it has joined already are not compared.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import LOWER_BYTES, segments, stored, texts
from scoreframe.llm import simhash_index
from scoreframe.llm.simhash_index import SEED, SPACES, _hashes, joined, keep_least

WIDTH = 5
#: Similarity that links, as a fraction of integers.
LEAST = (4, 5)
BANDS, DEPTH = 25, 5
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * DEPTH, np.uint64) | np.uint64(1)
#: Bytes of a list's sets that stay in memory, and hashes compared at a time.
IN_MEMORY, AT_ONCE = 32 << 20, 1 << 20


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted, distinct hashes of a text's word shingles; a shorter text is one shingle."""
    out, words = [], []
    for part in segments(text.translate(LOWER_BYTES), breaks=SPACES):
        words += part.split()
        out.append(_hashes(words, width))
        words = words[len(out[-1]) :]
    if not any(map(len, out)) and words:
        out = [np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)]
    return np.unique(np.concatenate(out))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * DEPTH, ~np.uint64(0))
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096, None] * _FACTORS).min(axis=0), out=least)
    bands = least.astype("<u8").reshape(BANDS, DEPTH)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)], np.uint64).view(np.int64)


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prints: bool = False) -> DataFrame:
    """``doc_id, fp, digest, keys`` per row; ``fp`` names the set of shingles, one without words has no keys.

    ``prints`` adds ``print``, the SimHash fingerprint, from the same reading of the texts.
    """
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        F.sha2(F.coalesce(docs[text_col], F.lit("")), 256).alias("digest"),
        docs[text_col].cast("string").alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys, marks = [], [], []
            for t in texts(batch.column("text")):
                h = shingles(t)
                if prints:
                    marks.append(simhash_index.fingerprint(t))
                nodes.append(_node(h))
                keys.append(band_keys(h))
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            columns = [
                batch.column("doc_id"), pa.array(np.array(nodes, np.uint64).view(np.int64)), batch.column("digest"),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *keys]))),
            ]
            if prints:
                columns.append(pa.array(np.array(marks, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "digest", "keys", *["print"] * prints])

    return rows.mapInArrow(run, f"doc_id {kind}, fp long, digest string, keys array<long>" + ", print long" * prints)


def _lists(rows: DataFrame) -> DataFrame:
    """``list, fp``: the lists of two nodes or more, named by their nodes."""
    nodes = rows.groupBy("fp").agg(F.first("keys").alias("keys"))
    posted = nodes.select(F.explode("keys").alias("key"), "fp").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            mixed = fp.view(np.uint64) ^ (fp.view(np.uint64) >> np.uint64(29))
            names = np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), starts)
            several = np.repeat(sizes > 1, sizes)
            names = np.repeat(names, sizes)[several].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(fp[several])], ["list", "fp"])

        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy()])
            # The last list may go on in the next batch.
            end = np.flatnonzero(key != key[-1]) if len(key) else []
            if len(end):
                cut = int(end[-1]) + 1
                yield found(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield found(key, fp)

    # Two lists that happen to get one name are compared as one, which is more work and no error.
    return posted.mapInArrow(run, "list long, fp long").distinct()


def _sets(docs: DataFrame, rows: DataFrame, lists: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``fp, n, hashes`` of each node in a list."""
    listed = lists.select("fp").distinct()
    one = rows.join(listed, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("digest", "doc_id")).alias("m"))
    one = one.select("fp", F.col("m.digest").alias("_digest"), F.col("m.doc_id").alias("_id"))
    own = docs.select(
        docs[id_col].alias("id"),
        F.sha2(F.coalesce(docs[text_col], F.lit("")), 256).alias("digest"),
        docs[text_col].cast("string").alias("text"),
    )
    found = own.join(one, F.expr("digest = _digest AND id <=> _id")).select("fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in texts(batch.column("text"))]
            columns = [batch.column("fp"), pa.array([len(s) for s in sets], pa.int64())]
            columns.append(pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["fp", "n", "hashes"])

    # Rows that repeat id and text are one.
    return found.mapInArrow(run, "fp long, n long, hashes binary").dropDuplicates(["fp"])


class _List:
    """The sets of one list in order of size."""

    def __init__(self):
        self.fps, self.sizes, self.file = [], [], tempfile.SpooledTemporaryFile(IN_MEMORY)

    def add(self, fp: int, hashes: bytes) -> None:
        self.fps.append(fp)
        self.sizes.append(len(hashes) // 8)
        self.file.write(hashes)

    def _read(self, at: int, end: int) -> np.ndarray:
        self.file.seek(8 * int(self.ends[at]))
        return np.frombuffer(self.file.read(8 * int(self.ends[end] - self.ends[at])), "<u8")

    def links(self) -> Iterator[tuple[int, int]]:
        """A spanning forest of the pairs that are similar enough."""
        n, d = LEAST
        sizes = np.array(self.sizes, np.int64)
        self.ends = np.r_[0, np.cumsum(sizes)]
        group = np.arange(len(sizes))
        for i in range(len(sizes)):
            own = self._read(i, i + 1)
            # A set larger by more than d / n is too unlike.
            last = int(np.searchsorted(sizes, sizes[i] * d // n, "right"))
            at = i + 1
            while at < last:
                if group[at] == group[i]:
                    at += 1
                    continue
                end = min(max(int(np.searchsorted(self.ends, self.ends[at] + AT_ONCE)), at + 1), last)
                joint = np.flatnonzero(group[at:end] == group[i])
                end = at + int(joint[0]) if len(joint) else end
                other = self._read(at, end)
                place = np.minimum(np.searchsorted(own, other), len(own) - 1)
                both = np.add.reduceat((own[place] == other).astype(np.int64), self.ends[at:end] - self.ends[at])
                for j in (at + np.flatnonzero((d + n) * both >= n * (sizes[i] + sizes[at:end]))).tolist():
                    if group[j] != group[i]:
                        group[group == group[j]] = group[i]
                        yield self.fps[i], self.fps[j]
                at = end
        self.file.close()


def links(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a, b``: verified links between nodes, each list's as a forest."""
    lists = stored(_lists(rows), "lists")
    sets = stored(_sets(docs, rows, lists, id_col, text_col), "sets")
    met = lists.join(sets, "fp").repartition("list").sortWithinPartitions("list", "n", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        name, now = None, _List()
        for batch in batches:
            found = []
            columns = [batch.column(c) for c in ("list", "fp", "hashes")]
            for at, fp, hashes in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2], strict=True):
                if at != name:
                    found += now.links()
                    name, now = at, _List()
                now.add(fp, hashes.as_buffer())
            yield out(found)
        yield out([*now.links()])

    return met.select("list", "fp", "hashes").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, digest, component_id, root``, as ``simhash_index.near_duplicates``.

    Texts without words (null too) are one set; an empty table gives an empty result; other columns
    are not read.
    """
    rows = stored(sketches(docs, id_col, text_col), "sketches")
    return joined(rows.select("doc_id", "fp", "digest"), stored(links(docs, rows, id_col, text_col), "links"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of near copies, that with the least id, with all its columns."""
    return keep_least(docs, near_copies(docs, id_col, text_col), id_col, text_col)


def simhash_and_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups of ``simhash_index.near_duplicates``, joined further by links of near copies.

    One row per row of ``docs``, as both return. Rows are found by their SimHash fingerprints; the exact
    comparison of shingle sets joins groups whose fingerprints differ in more bits. A fingerprint and a set
    that share a row are linked, so a row lies in one component of both kinds of links.
    """
    rows = stored(sketches(docs, id_col, text_col, prints=True), "sketches")
    edges = stored(simhash_index.links(rows.select(F.col("print").alias("fp"))), "links")
    edges = edges.unionByName(stored(links(docs, rows, id_col, text_col), "links"))
    edges = edges.unionByName(rows.select(F.col("print").alias("a"), F.col("fp").alias("b")).distinct())
    return joined(rows.select("doc_id", "fp", "digest"), edges)


def drop_simhash_and_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that with the least id, with all its columns."""
    return keep_least(docs, simhash_and_near_copies(docs, id_col, text_col), id_col, text_col)
