"""Connected components by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import stored


def _linked_to_least(edges: DataFrame) -> DataFrame:
    """Edges with ``m``, the least of ``u`` and its neighbours.

    The minimum combines in the map tasks. It gets a key of its own, equal to ``u``, so that the join
    shuffles both sides and AQE can split the edges of a node that very many others name.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    least = least.select(F.col("u").bitwiseXOR(F.lit(0)).alias("u"), "m")
    return edges.join(least, "u")


def _both(edges: DataFrame, names: tuple[str, ...], *rows: tuple[str, ...]) -> DataFrame:
    """For each edge the ``rows``, tuples of SQL texts, from one reading of the edges."""
    structs = [F.struct(*[F.expr(e).alias(n) for e, n in zip(r, names, strict=True)]) for r in rows]
    return edges.select(F.inline(F.array(*structs)))


def _stars(edges: DataFrame) -> bool:
    """Whether each node is a root or names one root, so that no step would change anything."""
    ends = _both(edges, ("node", "up", "down"), ("u", "1", "0"), ("v", "0", "1"))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if(F.expr("up > 1 OR up = 1 AND down = 1"))).first()[0] == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of an edge, the root being the least node reachable.

    Edges in either direction, repeated edges and loops count once; edges with nulls are left out.
    Each step is written to the shared folder, so lineage stays short; only a count reaches the driver.
    Steps grow with the logarithm of the largest diameter.
    """
    cur = edges.where(f"{a} IS NOT NULL AND {b} IS NOT NULL")
    cur = stored(cur.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    loops = cur.where("u = v")
    cur = cur.where("u > v")
    while not _stars(cur):
        # Stored, since the small-star step reads it twice; no more rows than edges, repeats included.
        large = _linked_to_least(_both(cur, ("u", "v"), ("u", "v"), ("v", "u"))).where("v > u")
        large = stored(large.select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        small = _both(_linked_to_least(large), ("u", "v"), ("v", "m"), ("u", "m"))
        cur = stored(small.where("u > v").distinct(), "edges")
    named = _both(cur, ("node", "root"), ("u", "v"), ("v", "v"))
    named = named.unionByName(loops.select(F.col("v").alias("node"), F.col("v").alias("root")))
    return named.groupBy("node").agg(F.min("root").alias("root"))
