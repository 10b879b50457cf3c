"""Product codes of vectors, fitted and assigned through dictionaries of the values in each dimension.

Components become integers and each block of vectors is stored once as a dictionary of the distinct
integers in every dimension and a code per component. To measure a block against a codebook, the squared
differences of every distinct integer to all entries are tabulated per dimension; the distance of a
part is then a gather from those tables and an add per dimension. Sums of the parts given to an entry
come from counts of (entry, code) and the dictionary, so all arithmetic is on integers and exact.

At scale: a block holds a bounded number of components and its dictionary at most as many values, so
a task's memory doesn't grow with the table. A round reads the stored blocks (two bytes per
component as a rule) and shuffles one row per task, entry and dimension; the driver sees the codebooks
only, ``entries`` x dimensions integers. Label sums combine in the map tasks, whatever a label's share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components of a block.
BLOCK_VALUES = 1 << 20
#: Scaled components of this size or more count as not finite: their sums would leave a decimal.
LIMIT = 1 << 61


@dataclass(frozen=True)
class Codebooks:
    """``values[entry, dimension]`` as integers and the first dimension of each part."""

    values: np.ndarray
    bounds: tuple[int, ...]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, joined by commas."""
        parts = (self.values[:, a:b].ravel() for a, b in zip(self.bounds, self.bounds[1:], strict=False))
        return hashlib.sha256(",".join(str(v) for p in parts for v in p.tolist()).encode()).hexdigest()

    def decode(self, codes: np.ndarray, scale: int = SCALE) -> np.ndarray:
        """Approximate vectors of ``codes[row, part]``: the middle of each entry's integer cells."""
        cut = zip(self.bounds, self.bounds[1:], strict=False)
        return np.hstack([(self.values[codes[:, p], a:b] + 0.5) / scale for p, (a, b) in enumerate(cut)])


def part_bounds(size: int, parts: int) -> tuple[int, ...]:
    """First dimension of each part, and the end; as equal as ``size`` allows."""
    return tuple(k * size // parts for k in range(parts + 1))


class Block:
    """The dictionaries of a block and the codes of its vectors, dimension by dimension."""

    def __init__(self, values: list[np.ndarray], codes: np.ndarray):
        self.values, self.codes = values, codes

    @classmethod
    def of(cls, vectors: np.ndarray) -> Block:
        pairs = [np.unique(column, return_inverse=True) for column in np.ascontiguousarray(vectors.T)]
        codes = np.array([c for _, c in pairs], np.uint32).reshape(len(pairs), len(vectors))
        return cls([v for v, _ in pairs], codes)

    def dump(self) -> tuple[bytes, bytes, bytes]:
        """Sizes of the dictionaries, their values, and the codes in the least width that holds them."""
        sizes = np.array([len(v) for v in self.values], "<u4")
        kind = "<u2" if sizes.max(initial=0) <= 1 << 16 else "<u4"
        values = np.concatenate([np.empty(0, np.int64), *self.values])
        return sizes.tobytes(), values.astype("<i8").tobytes(), self.codes.astype(kind).tobytes()

    @classmethod
    def load(cls, n: int, sizes: bytes, values: bytes, codes: bytes) -> Block:
        ends = np.cumsum(np.frombuffer(sizes, "<u4"))
        kind = "<u2" if len(codes) == 2 * n * len(ends) else "<u4"
        all_values = np.frombuffer(values, "<i8")
        return cls(np.split(all_values, ends[:-1]) if len(ends) else [], np.frombuffer(codes, kind).reshape(len(ends), n))

    def _plain(self, books: Codebooks) -> bool:
        """Whether a distance over all dimensions stays within 64 bits."""
        most = max((int(abs(v).max()) for v in [*self.values, books.values] if v.size), default=0)
        return 4 * most * most * max(len(self.values), 1) < 1 << 63

    def assign(self, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry per part, ties to the lower one, and the squared distances summed over parts."""
        n, parts = self.codes.shape[1], len(books.bounds) - 1
        kind = np.int64 if self._plain(books) else object
        codes, error = np.zeros((n, parts), np.uint8 if len(books.values) <= 256 else np.int32), np.zeros(n, kind)
        for p, (a, b) in enumerate(zip(books.bounds, books.bounds[1:], strict=False)):
            distance = np.zeros((n, len(books.values)), kind)
            for d in range(a, b):
                gap = self.values[d].astype(kind)[:, None] - books.values[:, d].astype(kind)[None, :]
                distance += (gap * gap)[self.codes[d]]
            nearest = distance.argmin(axis=1) if n else np.zeros(0, np.int64)
            codes[:, p] = nearest
            error += distance[np.arange(n), nearest]
        return codes, error

    def sums(self, codes: np.ndarray, books: Codebooks) -> tuple[np.ndarray, list[list[int]]]:
        """How many parts each entry got, by part, and their sums per dimension and entry."""
        entries, out = len(books.values), []
        counts = np.array([np.bincount(codes[:, p], minlength=entries) for p in range(codes.shape[1])])
        for p, (a, b) in enumerate(zip(books.bounds, books.bounds[1:], strict=False)):
            for d in range(a, b):
                v = self.values[d]
                both = np.bincount(codes[:, p].astype(np.int64) * len(v) + self.codes[d], minlength=entries * len(v))
                small = not len(v) or int(abs(v).max()) * codes.shape[0] < 1 << 62
                out.append((both.reshape(entries, len(v)) @ (v if small else v.astype(object))).tolist())
        return counts, out


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
             scale: int = SCALE) -> DataFrame:
    """``id, label, v``: floor(scale * x) of each component, as array<long>.

    Left out are rows whose vector is null, holds null or a component that isn't finite (one of 2^61 or more when scaled
    counts as such).
    """
    rows = vectors.select(
        vectors[id_col].alias("id"),
        (vectors[label_col] if label_col else F.lit(None).cast("int")).alias("label"),
        F.transform(vectors[vector_col], lambda x: F.lit(float(scale)) * x.cast("double")).alias("v"),
    )
    # NaN sorts above all numbers, so the comparison is false for it too.
    fine = F.forall("v", lambda x: F.coalesce(F.abs(x) < float(LIMIT), F.lit(False)))
    return rows.where(F.coalesce(fine, F.lit(False))).withColumn("v", F.transform("v", lambda x: F.floor(x)))


def _start(rows: DataFrame, entries: int) -> tuple[np.ndarray, int]:
    """Vectors of the smallest ids, nulls behind all others, and the number of their dimensions."""
    order = [F.col("id").asc_nulls_last(), F.col("v").asc()]
    size = rows.orderBy(*order).select(F.size("v")).limit(1).collect()
    size = size[0][0] if size else 0
    first = rows.where(F.size("v") == size).orderBy(*order).select("v").limit(entries).collect()
    return np.array([r.v for r in first], np.int64).reshape(len(first), size), size


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """A row per block: ids, labels and what :meth:`Block.dump` gives."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    most = max(BLOCK_VALUES // max(size, 1), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out(table: pa.Table) -> pa.RecordBatch:
            vectors = table.column("v").combine_chunks()
            flat = vectors.flatten() if isinstance(vectors, pa.ListArray) else pa.concat_arrays([c.flatten() for c in vectors.chunks])
            sizes, values, codes = Block.of(flat.to_numpy(zero_copy_only=False).reshape(-1, size) if size else np.empty((len(table), 0))).dump()
            lists = [pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for c in ("id", "label")]
            binary = [pa.array([x], pa.binary()) for x in (sizes, values, codes)]
            return pa.RecordBatch.from_arrays([*lists, *binary], ["id", "label", "sizes", "values", "codes"])

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if n + part.num_rows > most:
                    yield out(pa.Table.from_batches(held))
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield out(pa.Table.from_batches(held))

    schema = f"id array<{kinds['id']}>, label array<{kinds['label']}>, sizes binary, values binary, codes binary"
    return rows.where(F.size("v") == size).mapInArrow(run, schema)


def _loaded(batch: pa.RecordBatch, k: int) -> Block:
    return Block.load(len(batch.column("id")[k]), *(batch.column(c)[k].as_py() for c in ("sizes", "values", "codes")))


def _improved(blocks: DataFrame, books: Codebooks) -> Codebooks:
    """One round: entries replaced by the floored mean of the parts nearest to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, size = len(books.bounds) - 1, len(books.values), books.values.shape[1]
        counts, sums = np.zeros((parts, entries), np.int64), [[0] * entries for _ in range(size)]
        for batch in batches:
            for k in range(batch.num_rows):
                block = _loaded(batch, k)
                n, s = block.sums(block.assign(books)[0], books)
                counts += n
                sums = [[x + y for x, y in zip(a, b, strict=True)] for a, b in zip(sums, s, strict=True)]
        part = np.repeat(np.arange(parts), np.diff(books.bounds))
        rows = [(d, e, int(counts[part[d], e]), str(sums[d][e])) for d in range(size) for e in range(entries) if counts[part[d], e]]
        kinds = (("dim", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [c for c, _ in kinds])

    found = blocks.select("id", "sizes", "values", "codes").mapInArrow(run, "dim int, entry int, n long, total string")
    found = found.groupBy("dim", "entry").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    values = books.values.copy()
    for r in found.collect():
        values[r.entry, r.dim] = int(r.total) // r.n
    return Codebooks(values, books.bounds)


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """``id, label, codes, error`` per vector that stays (codes: array<int>, one per part) and the codebooks.

    Codebooks start as the parts of the ``entries`` smallest ids (fewer rows: fewer entries). See :func:`integers` for rows
    left out; so are vectors of another length than that of the smallest id, which no codebook fits. A length that the
    parts don't divide makes parts of nearly equal length. Null ids come last and repeated rows are rows of their own.
    ``error`` is null where it exceeds a long. An empty table gives an empty result. Other columns are not read.
    """
    rows = integers(vectors, id_col, vector_col, label_col, scale)
    start, size = _start(rows, entries)
    books = Codebooks(start, part_bounds(size, parts))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    blocks = stored(_blocks(rows, size), "vector-blocks")
    for _ in range(rounds if len(start) else 0):
        books = _improved(blocks, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                codes, error = _loaded(batch, k).assign(books)
                ends = pa.array(np.arange(0, codes.size + 1, parts), pa.int32())
                error = pa.array([e if e < 1 << 63 else None for e in error.tolist()], pa.int64())
                lists = pa.ListArray.from_arrays(ends, pa.array(codes.ravel().astype(np.int32)))
                columns = [batch.column("id")[k].values, batch.column("label")[k].values, lists, error]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "codes", "error"])

    found = blocks.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, codes array<int>, error long")
    return stored(found, "vector-codes"), books


def hex_code(codes) -> F.Column:
    """Two lower-case hex digits per part (up to 256 entries)."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def label_errors(found: DataFrame) -> DataFrame:
    """``label, label_error``: errors summed over equal labels, nulls together; null where a long doesn't hold the sum."""
    whole = F.count("error") == F.count(F.lit(1))
    sums = found.groupBy("label").agg(F.when(whole, F.try_sum("error")).alias("label_error"))
    # Stored, so that its size is known when a join decides whether to send it to all tasks.
    return stored(sums, "label-errors")
