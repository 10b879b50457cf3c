"""Near duplicates by SimHash fingerprints and an inverted index on their positional bytes.

Two 64-bit fingerprints that differ in at most ``max_bits`` bits share at least ``8 - max_bits`` of
their 8 positional bytes: the guaranteed minimum of the count filter. A posting list is kept for
every set of that many positions, so each pair that reaches the minimum meets in a list, and no
other pair meets anywhere. Within a list the shared bytes of each candidate pair are tallied and the
bits verified.

At scale: copies of one text have one fingerprint, and only distinct fingerprints enter the index.
A list's members agree in all but ``max_bits`` bytes, so with 2 free bytes a list has at most 65,536
members however large the corpus is. Long lists are searched by the few bit patterns that can
differ, not by pairs, and hand on a spanning forest of their links: components lose nothing, and a
list of g fingerprints yields at most g - 1 rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import LOWER_BYTES, keep_rows, segments, stored, texts
from scoreframe.llm.components import components

SEED = 42
SPACES = b" \t\n\x0b\x0c\r"
#: BITS[v, k] is bit k of the byte v.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: Lists up to this length compare neighbours by offset, longer ones look differing patterns up.
SHORT = 32


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    digest, join = xxhash.xxh64_intdigest, b" ".join
    grams = zip(*(words[i:] for i in range(width)), strict=False)
    return np.fromiter((digest(join(g), SEED) for g in grams), np.uint64, max(len(words) - width + 1, 0))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    by_byte = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ BITS for k in range(8)])


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the word shingles of a lower-cased text, repeats included, as an unsigned integer."""
    ones, n, words = np.zeros(64, np.int64), 0, []
    for part in segments(text.translate(LOWER_BYTES), breaks=SPACES):
        words += part.split()
        h = _hashes(words, width)
        ones += _bit_counts(h)
        n += len(h)
        words = words[len(h) :]
    if not n and words:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        ones, n = _bit_counts(h), 1
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp, digest`` per row; texts without words (null too) have fingerprint 0."""
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        F.sha2(F.coalesce(docs[text_col], F.lit("")), 256).alias("digest"),
        docs[text_col].cast("string").alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in texts(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fps), batch.column("digest")], ["doc_id", "fp", "digest"]
            )

    return rows.mapInArrow(run, f"doc_id {kind}, fp long, digest string")


def _patterns(free: tuple[int, ...], max_bits: int) -> np.ndarray:
    bits = [8 * p + k for p in free for k in range(8)]
    sets = [c for n in range(1, max_bits + 1) for c in combinations(bits, n)]
    return np.array([sum(1 << b for b in c) for c in sets], np.uint64)


def _pairs(lists: np.ndarray, fp: np.ndarray, free: list[tuple[int, ...]], which: np.ndarray, max_bits: int):
    """Index pairs of rows of one list that reach the tally and the bit limit; rows are sorted by list."""
    starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
    sizes = np.diff(np.r_[starts, len(lists)])
    size = np.repeat(sizes, sizes)
    left, right = [], []
    short = np.flatnonzero((size > 1) & (size <= SHORT))
    for d in range(1, min(SHORT, int(sizes.max(initial=1)))):
        i = short[short + d < len(lists)]
        i = i[lists[i] == lists[i + d]]
        left.append(i)
        right.append(i + d)
    for s, n in zip(starts[sizes > SHORT], sizes[sizes > SHORT], strict=True):
        own = fp[s : s + n]
        order = np.argsort(own)
        ranked = own[order]
        for mask in _patterns(free[which[s]], max_bits):
            want = own ^ mask
            at = np.minimum(np.searchsorted(ranked, want), n - 1)
            hit = np.flatnonzero((ranked[at] == want) & (own < want))
            left.append(s + hit)
            right.append(s + order[at[hit]])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    diff = fp[i] ^ fp[j]
    tally = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    good = (tally >= 8 - max_bits) & (np.bitwise_count(diff) <= max_bits)
    return i[good], j[good]


def _forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every linked row to the least row it reaches."""
    nodes, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b, root = flat[: len(i)], flat[len(i) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """``a, b``: the links between the distinct values of ``fp``, each list's as a forest.

    A row joins a fingerprint to the least one it reaches within a list, over links verified there.
    """
    if not 0 < max_bits < 8:
        raise ValueError("max_bits must be from 1 to 7")
    free = list(combinations(range(8), max_bits))
    keep = [~sum(0xFF << 8 * p for p in f) & (1 << 64) - 1 for f in free]
    signed = [k - (1 << 64) if k >> 63 else k for k in keep]
    distinct = fps.select("fp").distinct()
    posted = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(k).cast("long")) for k in signed])))
    posted = posted.select(F.col("pos").cast("short").alias("which"), F.col("col").alias("bytes"), "fp")
    posted = posted.repartition("which", "bytes").sortWithinPartitions("which", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def found(rows: np.ndarray) -> pa.RecordBatch:
            which, key, fp = rows["which"], rows["bytes"], rows["fp"].view(np.uint64)
            new = np.r_[True, (which[1:] != which[:-1]) | (key[1:] != key[:-1])]
            i, j = _pairs(np.cumsum(new), fp, free, which, max_bits)
            i, j = _forest(i, j)
            return pa.RecordBatch.from_arrays([pa.array(rows["fp"][i]), pa.array(rows["fp"][j])], ["a", "b"])

        for batch in batches:
            rows = np.empty(batch.num_rows, [("which", np.int16), ("bytes", np.int64), ("fp", np.int64)])
            for name in rows.dtype.names:
                rows[name] = batch.column(name).to_numpy()
            rows = rows if rest is None else np.concatenate([rest, rows])
            if not len(rows):
                continue
            # The last list may go on in the next batch.
            end = np.flatnonzero((rows["which"] != rows["which"][-1]) | (rows["bytes"] != rows["bytes"][-1]))
            cut = int(end[-1]) + 1 if len(end) else 0
            if cut:
                yield found(rows[:cut])
            rest = rows[cut:]
        if rest is not None and len(rest):
            yield found(rest)

    return posted.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, digest, component_id, root``.

    ``component_id`` is the least id reachable over links, itself included; ``root`` is the
    least fingerprint, which names the component even if ids repeat. Null ids are left out of the minimum. Texts without words share fingerprint 0 and link like any other; repeated rows stay
    rows of one component; an empty table gives an empty result; other columns are not read.
    """
    rows = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    return joined(rows, stored(links(rows, max_bits), "links"))


def joined(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_id, fp, digest`` rows with ``component_id`` and ``root`` by the links ``a, b`` between values of ``fp``."""
    roots = components(edges)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    rooted = least.join(roots, F.col("fp") == F.col("node"), "left")
    rooted = rooted.select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy(F.col("root").alias("top")).agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, F.col("root") == F.col("top")).select("fp", "component_id", "root")
    return rows.join(named, "fp").select("doc_id", "fp", "digest", "component_id", "root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, that with the least id, with all its columns.

    Of several texts with that id, the one with the least digest stays.
    """
    return keep_least(docs, near_duplicates(docs, id_col, text_col, **options), id_col, text_col)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose id names their component in ``found``."""
    found = stored(found, "near")
    own = found.where("doc_id <=> component_id")
    first = own.groupBy("root").agg(F.min("digest").alias("first"))
    decided = found.alias("f").join(first.alias("g"), F.expr("f.root = g.root"), "left")
    decided = decided.select(
        F.col("f.doc_id").alias("_id"),
        F.col("f.digest").alias("_digest"),
        F.expr("f.doc_id <=> f.component_id AND f.digest = g.first").alias("_keep"),
    )
    return keep_rows(docs, decided, id_col, F.sha2(F.coalesce(docs[text_col], F.lit("")), 256))
