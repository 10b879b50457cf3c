"""Exact duplicates by naming fixed-size blocks, then pairs of names, until one name is left.

A block's bucket is its 64-bit hash; its name is the bucket and its place among the sorted,
distinct blocks of that bucket. Places above 0 exist only where two different blocks meet in a
bucket, which the bytes themselves decide, so names are integers that never collide and that any
task can work out alone. Each further level names adjacent pairs of names in the same way. Texts
with the same number of blocks have the same tree of pairs, so the number of blocks and the last
name identify a text.

At scale: the text is shuffled once, in blocks, behind a map-side minimum and maximum, so a block
that a third of all documents share sends one row per task. All later shuffles carry names only.
A document of any length costs its blocks once and as many levels as its block count doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.llm.common import keep_rows, lower_az, stored

BLOCK_BYTES = 1024


def _blocks(data: Column, size: int) -> Column:
    """Digest and blocks of a binary text, which is worked out once; an empty text is one empty block."""

    def cut(b: Column) -> Column:
        last = F.greatest(F.ceil(F.octet_length(b) / F.lit(size)), F.lit(1)).cast("int") - 1
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(b, i * size + 1, F.lit(size)))
        return F.struct(F.unhex(F.sha2(b, 256)).alias("sha"), parts.alias("blocks"))

    return F.transform(F.array(data), cut)[0]


def _clashes(named: DataFrame, content: str) -> DataFrame:
    """Buckets that hold more than one content."""
    bounds = named.groupBy("bucket").agg(F.min(content).alias("lo"), F.max(content).alias("hi"))
    return stored(bounds.where("lo < hi").select("bucket"), "clashes")


def _with_place(named: DataFrame, content: str, source: DataFrame) -> DataFrame:
    """Add ``nth``, the place of the content within its bucket."""
    clashes = _clashes(source, content)
    if clashes.isEmpty():
        return named.withColumn("nth", F.lit(0))
    order = Window.partitionBy("bucket").orderBy(content)
    places = source.join(clashes, "bucket").select("bucket", content).distinct()
    places = stored(places.withColumn("nth", F.row_number().over(order) - 1), "places")
    return named.join(places, ["bucket", content], "left").withColumn("nth", F.coalesce("nth", F.lit(0)))


def name_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    bucket: Callable[..., Column] = F.xxhash64,
) -> DataFrame:
    """One row per document: ``uid`` (row number), ``doc_id``, ``sha``, ``blocks``, ``bucket``, ``nth``.

    Rows with equal (``blocks``, ``bucket``, ``nth``) have equal texts and no others. Null texts are
    empty texts; repeated rows and null ids get rows of their own; other columns are not read.
    ``bucket`` may be any function from columns to a long: a weak one costs joins, never a collision.
    """
    data = F.encode(lower_az(docs[text_col]), "UTF-8")
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        docs[id_col].alias("doc_id"),
        _blocks(data, block_bytes).alias("b"),
    )
    only = docs.select(F.explode(_blocks(data, block_bytes)["blocks"]).alias("block"))
    only = only.select(bucket("block").alias("bucket"), "block")
    first = rows.select("uid", "doc_id", "b.sha", F.size("b.blocks").alias("blocks"), F.posexplode("b.blocks"))
    first = first.select(
        "uid", "doc_id", "blocks", "pos", bucket("col").alias("bucket"), F.col("col").alias("block"),
        F.when(F.col("pos") == 0, F.col("sha")).alias("sha"),
    )
    level = _with_place(first, "block", only).drop("block").withColumn("width", F.col("blocks"))
    level = stored(level, "names")
    done = []
    while True:
        done.append(level.where("width = 1"))
        rest = level.where("width > 1")
        if rest.isEmpty():
            break
        name = F.struct("bucket", "nth")
        pairs = rest.groupBy("uid", F.shiftright("pos", 1).alias("at")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, name)).alias("l"),
            F.max(F.when(F.col("pos") % 2 == 1, name)).alias("r"),
            *[F.max(c).alias(c) for c in ("doc_id", "blocks", "sha", "width")],
        )
        pairs = pairs.withColumn("bucket", bucket("l.bucket", "l.nth", "r.bucket", "r.nth"))
        pairs = stored(pairs.withColumn("pair", F.struct("l", "r")), "pairs")
        whole = pairs.where("r IS NOT NULL")
        # The last of an odd number of names keeps its name on the next level.
        single = pairs.where("r IS NULL").withColumn("bucket", F.col("l.bucket")).withColumn("nth", F.col("l.nth"))
        keep = ["uid", "doc_id", "blocks", "sha", "bucket", "nth", F.col("at").alias("pos"),
                F.ceil(F.col("width") / 2).cast("int").alias("width")]
        level = _with_place(whole, "pair", whole.select("bucket", "pair")).select(*keep).unionByName(single.select(*keep))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("uid", "doc_id", "sha", "blocks", "bucket", "nth")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays (null ids are smallest; of rows that repeat
    id and text, one). An empty table gives an empty result.
    """
    named = name_documents(docs, id_col, text_col, **options)
    key = ["blocks", "bucket", "nth"]
    groups = stored(
        named.groupBy(*key).agg(
            F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "uid")).alias("keep")
        ),
        "groups",
    )
    return named.join(groups, key).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("keep.uid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = exact_duplicates(docs, id_col, text_col)
    decided = found.select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"), F.col("kept").alias("_keep")
    )
    return keep_rows(docs, decided, id_col, F.sha2(F.encode(lower_az(docs[text_col]), "UTF-8"), 256))
