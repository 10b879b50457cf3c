"""How far the word use of each source is from the other sources of its language and from the language.

Each language keeps the terms of ``MIN_DOCS`` documents or more. They are sorted, cut into blocks, and each
block becomes a minimal acyclic transducer (``transducer``) whose ordinals are the terms' places. The texts
stream through the transducers for the counts, which are kept by ordinal, and ordinals break ties.

At scale: tasks add up before they hand on, so a hot source or word sends what any other sends. The
vocabulary never passes the driver as a whole: blocks are built by the tasks of a range sort and lie
in the shared folder, and the driver sees a row per block. Tasks hold the blocks of one pass, ``PASS_BYTES`` at most, and a
vocabulary over that takes more passes over the texts of its languages. Pairs of sources meet in groups of at most ``TILE``
by ``TILE`` sources and ``TERMS`` terms; the smaller the tiles, the more tasks share a hot language.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.llm.common import LOWER_BYTES, segments, shared_dir, stored, texts
from scoreframe.llm.files import reading, writing
from scoreframe.llm.transducer import Builder, Transducer

MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Terms of a transducer; its states are at most about as many as the bytes of its terms.
BLOCK_TERMS = 100_000
#: Stored bytes of the transducers that a task holds at a time.
PASS_BYTES = 64 << 20
#: Different terms, and pairs of source and term, that a task holds before it hands them on.
HELD_TERMS, HELD_COUNTS = 300_000, 2_000_000
#: Sources and terms of a group of pairs.
TILE, TERMS = 128, 8192
#: Bytes of text that stream through at a time.
CHUNK = 1 << 21

# Letters of ASCII and all beyond it. A byte of UTF-8 over 0x7F belongs to a character beyond ASCII.
WORD = re.compile(rb"[A-Za-z\x80-\xff]+")
_BREAKS = b" \n\t.,;:0123456789"
_IN_WORD = np.zeros(256, np.bool_)
_IN_WORD[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _rows(docs: DataFrame) -> DataFrame:
    """``text, lang, source`` with null as ''."""
    return docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def kept_terms(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term`` of the terms in at least ``min_docs`` documents of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[bytes]] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            columns = [
                pa.array([k for k, c in held.items() for _ in c], pa.string()),
                pa.array([t for c in held.values() for t in c], pa.binary()).cast(pa.string()),
                pa.array([n for c in held.values() for n in c.values()], pa.int64()),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["lang", "term", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch.column("text")), strict=True):
                seen = set()
                for part in segments(text.translate(LOWER_BYTES), breaks=_BREAKS):
                    seen.update(WORD.findall(part))
                held[lang].update(seen)
                if sum(map(len, held.values())) > HELD_TERMS:
                    yield out()
        yield out()

    found = rows.select("lang", "text").mapInArrow(run, "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("lang", "term")


class Block(NamedTuple):
    """A stored transducer; ``first`` is the ordinal of its least term in the language."""

    lang: str
    path: str
    first: int
    terms: int
    size: int


def vocabulary(kept: DataFrame) -> list[Block]:
    """The transducers of all languages, in the order of language and term.

    The tasks of a range sort build them, so neighbours in the order lie in one block or in the next one.
    """
    spark, directory = kept.sparkSession, shared_dir(kept.sparkSession, "transducers")
    kept = stored(kept, "terms")
    dealt = kept.repartitionByRange(kept.count() // BLOCK_TERMS + 1, "lang", "term").sortWithinPartitions("lang", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, builder, now, terms, nth = TaskContext.get(), Builder(), None, 0, 0

        def out() -> pa.RecordBatch:
            path = f"{directory}/{task.partitionId():06d}-{task.taskAttemptId()}-{nth:04d}.mat"
            data = builder.done().dump()
            with writing(path) as f:
                f.write(data)
            values = {"lang": now, "part": task.partitionId(), "nth": nth, "terms": terms, "bytes": len(data), "path": path}
            return pa.RecordBatch.from_pylist([values], schema)

        for batch in batches:
            for lang, term in zip(batch.column("lang").to_pylist(), texts(batch.column("term")), strict=True):
                if terms and (lang != now or terms == BLOCK_TERMS):
                    yield out()
                    builder, terms, nth = Builder(), 0, nth + 1
                builder.add(term)
                now, terms = lang, terms + 1
        if terms:
            yield out()

    schema = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("nth", pa.int32()), ("terms", pa.int64()), ("bytes", pa.int64()), ("path", pa.string())])
    built = stored(dealt.mapInArrow(run, "lang string, part int, nth int, terms long, bytes long, path string"), "blocks")
    found, first = [], Counter()
    for r in sorted(map(tuple, built.collect())):
        found.append(Block(r[0], r[5], first[r[0]], r[3], r[4]))
        first[r[0]] += r[3]
    return found


_LOADED: dict[str, Transducer] = {}


def _transducer(path: str, wanted: set[str]) -> Transducer:
    """One of the blocks a worker holds; those of another pass leave."""
    if path not in _LOADED:
        for other in [*_LOADED]:
            if other not in wanted:
                del _LOADED[other]
        with reading(path) as f:
            _LOADED[path] = Transducer.load(f.read())
    return _LOADED[path]


class _Tally:
    """Occurrences by source and ordinal in one language, as a task counts them."""

    def __init__(self):
        self.sources: dict[str, int] = {}
        self.keys, self.n = [], []

    def add(self, source: np.ndarray, ordinal: np.ndarray) -> None:
        keys, n = np.unique(source << 40 | ordinal, return_counts=True)
        self.keys.append(keys)
        self.n.append(n)

    def merge(self) -> int:
        """How many pairs are held, each once."""
        if len(self.keys) > 1:
            keys, where = np.unique(np.concatenate(self.keys), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, where, np.concatenate(self.n))
            self.keys, self.n = [keys], [total]
        return sum(map(len, self.keys))

    def rows(self, lang: str) -> pa.RecordBatch:
        self.merge()
        keys, n = (np.concatenate([np.empty(0, np.int64), *x]) for x in (self.keys, self.n))
        names = pa.array([*self.sources], pa.string()).take(pa.array(keys >> 40))
        columns = [pa.array([lang] * len(keys), pa.string()), names, pa.array(keys & ((1 << 40) - 1)), pa.array(n)]
        self.keys, self.n = [], []
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "ord", "n"])


def _stream(data: bytes, docs_at: list[int], source: list[int], blocks: list[tuple[Transducer, int]], tally: _Tally) -> None:
    """Count the terms of one buffer; ``docs_at``: where each document's bytes begin."""
    view = np.frombuffer(data, np.uint8)
    edge = np.diff(_IN_WORD[view].astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = np.array(source, np.int64)[np.searchsorted(docs_at, start, "right") - 1]
    for block, first in blocks:
        found = block.ordinals(view, start, end - start)
        hit = found >= 0
        if hit.any():
            tally.add(of[hit], found[hit] + first)
        # A word is a term of one block at most.
        start, end, of = start[~hit], end[~hit], of[~hit]


def count_terms(rows: DataFrame, blocks: list[Block]) -> DataFrame:
    """``lang, source, ord, n``: occurrences of the terms of ``blocks``."""
    by_lang: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for b in blocks:
        by_lang[b.lang].append((b.path, b.first))
    wanted = {b.path for b in blocks}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, _Tally] = defaultdict(_Tally)
        waiting: dict[str, tuple[list[bytes], list[int], list[int]]] = defaultdict(lambda: ([], [], [0]))

        def stream(lang: str) -> None:
            parts, source, at = waiting.pop(lang)
            ready = [(_transducer(p, wanted), first) for p, first in by_lang[lang]]
            _stream(b"".join(parts), at[:-1], source, ready, tallies[lang])

        for batch in batches:
            names = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            for (lang, name), text in zip(names, texts(batch.column("text")), strict=True):
                if lang not in by_lang:
                    continue
                sources = tallies[lang].sources
                k = sources.setdefault(name, len(sources))
                for part in segments(text.translate(LOWER_BYTES), CHUNK, _BREAKS):
                    parts, source, at = waiting[lang]
                    parts.append(part + b"\0")
                    source.append(k)
                    at.append(at[-1] + len(part) + 1)
                    if at[-1] >= CHUNK:
                        stream(lang)
            for lang, tally in tallies.items():
                if sum(map(len, tally.keys)) > HELD_COUNTS and tally.merge() > HELD_COUNTS // 2:
                    yield tally.rows(lang)
        for lang in [*waiting]:
            stream(lang)
        for lang, tally in tallies.items():
            yield tally.rows(lang)

    mine = rows.where(F.col("lang").isin([*by_lang]))
    found = mine.mapInArrow(run, "lang string, source string, ord long, n long")
    return found.groupBy("lang", "source", "ord").agg(F.sum("n").alias("n"))


def _passes(blocks: list[Block], most: int) -> Iterator[list[Block]]:
    now: list[Block] = []
    for b in blocks:
        if now and sum(x.size for x in now) + b.size > most:
            yield now
            now = []
        now.append(b)
    if now:
        yield now


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * n / total), three digits at a time, so that longs hold it for any count."""
    whole, rest = F.lit(0).cast("long"), n
    for _ in range(3):
        scaled = rest * 1000
        whole, rest = whole * 1000 + _div(scaled, total), scaled % total
    return whole + 1


def _gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _groups(rows: DataFrame, counts: DataFrame, blocks: list[Block]) -> DataFrame:
    """A row per source of a language: ``gid, lang, source, v`` (kept terms), ``total, lang_total, tile, tiles``."""
    terms = Counter()
    for b in blocks:
        terms[b.lang] += b.terms
    kept = rows.sparkSession.createDataFrame([*terms.items()], "lang string, v long")
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    found = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(kept, "lang", "left")
    found = stored(found.na.fill(0, ["n", "v"]).withColumn("gid", F.monotonically_increasing_id()), "groups")
    langs = found.groupBy("lang").agg(F.sum("n").alias("all"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    return stored(
        found.join(langs, "lang").select(
            "gid", "lang", "source", "v", (F.col("n") + 2 * F.col("v")).alias("total"),
            (F.col("all") + 2 * F.col("v")).alias("lang_total"),
            F.pmod(F.xxhash64("source"), "tiles").cast("int").alias("tile"), "tiles",
        ),
        "sources",
    )


def _telling(entries: DataFrame, blocks: list[Block], top: int) -> DataFrame:
    """The ``top`` terms of each source whose share most exceeds that of the language."""
    of_lang = F.sum("n").over(Window.partitionBy("lang", "ord"))
    q = entries.withColumn("q", _share(of_lang + 2, F.col("lang_total"))).where(F.col("p") > F.col("q"))
    order = Window.partitionBy("gid").orderBy(F.desc("value"), "ord")
    best = q.select("gid", "lang", "ord", _gap(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(order))
    best = best.where(F.col("rank") <= top).sortWithinPartitions("lang", "ord")
    firsts: dict[str, list[int]] = defaultdict(list)
    paths: dict[str, list[str]] = defaultdict(list)
    for b in blocks:
        firsts[b.lang].append(b.first)
        paths[b.lang].append(b.path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            for lang, at in zip(batch.column("lang").to_pylist(), batch.column("ord").to_pylist(), strict=True):
                k = bisect_right(firsts[lang], at) - 1
                names.append(_transducer(paths[lang][k], {paths[lang][k]}).term(at - firsts[lang][k]))
            columns = [batch.column("gid"), pa.array(names, pa.binary()).cast(pa.string()), batch.column("value"), batch.column("rank")]
            yield pa.RecordBatch.from_arrays(columns, ["gid", "item", "value", "rank"])

    return best.mapInArrow(run, "gid long, item string, value long, rank int")


def _tile_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Both directions of each pair of sources of two tiles, summed over the terms of one block."""
    _, block, a, b = key
    base = rows[rows["at"] < 0].sort_values("gid")
    ids, plain, tile = (base[c].to_numpy() for c in ("gid", "p", "tile"))
    rest = rows[rows["at"] >= 0]
    ats, column = np.unique(rest["at"].to_numpy(), return_inverse=True)
    p = np.repeat(plain[:, None], len(ats), axis=1)
    p[np.searchsorted(ids, rest["gid"].to_numpy()), column] = rest["p"].to_numpy()
    absent = max(min(int(base["v"].iloc[0]) - block * TERMS, TERMS), 0) - len(ats)
    out: list[tuple[np.ndarray, ...]] = []
    for i in np.flatnonzero(tile == a):
        other = np.flatnonzero(tile == b)
        other = other[other > i] if a == b else other
        gap, both = plain[i] - plain[other], np.maximum(plain[i] + plain[other], 1)
        value = gap * gap // both * absent
        if len(ats):
            gap = p[i] - p[other]
            value = value + (gap * gap // (p[i] + p[other])).sum(axis=1)
        one = np.full(len(other), ids[i])
        out += [(one, ids[other], value), (ids[other], one, value)]
    columns = [np.concatenate([np.empty(0, np.int64), *(o[k] for o in out)]) for k in range(3)]
    return pd.DataFrame(dict(zip(("gid", "other", "value"), columns, strict=True)))


def _pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Every other source of the language with the summed distance over all kept terms, ranked."""
    last = F.greatest(F.ceil(F.col("v") / TERMS).cast("int"), F.lit(1)) - 1
    # A source without occurrences in a block of terms has its least share for all of them.
    least = F.when(F.col("v") > 0, _share(F.lit(2).cast("long"), F.greatest("total", F.lit(1).cast("long")))).otherwise(F.lit(0).cast("long"))
    names = ["lang", "gid", "v", "tile", "tiles"]
    plain = groups.select(*names, F.explode(F.sequence(F.lit(0), last)).alias("block"), F.lit(-1).alias("at"), least.alias("p"))
    held = entries.select(
        *names, (F.col("ord") / TERMS).cast("int").alias("block"), (F.col("ord") % TERMS).cast("int").alias("at"), "p"
    )
    tiles = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda y: F.struct(F.least("tile", y).alias("a"), F.greatest("tile", y).alias("b")))
    met = plain.unionByName(held).withColumn("t", F.explode(tiles)).select("lang", "block", "t.a", "t.b", "gid", "v", "tile", "at", "p")
    sums = met.groupBy("lang", "block", "a", "b").applyInPandas(_tile_sums, "gid long, other long, value long")
    sums = sums.groupBy("gid", "other").agg(F.sum("value").alias("value"))
    sums = sums.join(groups.select(F.col("gid").alias("other"), F.col("source").alias("item")), "other")
    order = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    return sums.select("gid", "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``; part ``pair`` ranks the other sources of the language, ``term`` the telling terms.

    Null texts, languages and sources are ''. Repeated rows count again. A source without terms, or one of a language that keeps
    none, has its pairs at the value its least shares give (0 if the language keeps none) and no terms; a language of one source
    has no pairs; an empty table gives an empty result. Words of any length and texts of any size are read whole. Other
    columns are not read.
    """
    rows = _rows(docs)
    blocks = vocabulary(kept_terms(rows, min_docs))
    counted = [count_terms(rows, now) for now in _passes(blocks, PASS_BYTES)]
    empty = rows.sparkSession.createDataFrame([], "lang string, source string, ord long, n long")
    counts = stored(reduce(DataFrame.unionByName, counted or [empty]), "counts")
    groups = _groups(rows, counts, blocks)
    entries = counts.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n") + 2, F.col("total")))
    parts = [(_pairs(entries, groups), "pair"), (_telling(entries, blocks, top), "term")]
    found = reduce(DataFrame.unionByName, [d.withColumn("part", F.lit(name)) for d, name in parts])
    return found.join(groups.select("gid", "lang", "source"), "gid").select("lang", "source", "part", "item", "value", "rank")
