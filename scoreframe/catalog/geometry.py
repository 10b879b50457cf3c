"""Geometry cells."""

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import spread
from .registry import from_view, query


def _geoms(spark, sf):
    return spread(from_view(spark, sf, "geoms"), "id")


@query(
    "is_wkt",
    "O66",
    """SELECT id, regexp_full_match(upper(trim(actual)), '(SRID=\\d+;)?(POINT|LINESTRING|POLYGON)( Z| M| ZM)?\\s*\\(.*\\)') AS wkt FROM $geoms""",
)
def is_wkt(spark, sf):
    return _geoms(spark, sf).select("id", G.is_wkt("actual").alias("wkt"))


@query(
    "is_hex_wkb",
    "O67",
    """SELECT id, length(actual) >= 16 AND regexp_full_match(actual, '[0-9A-Fa-f]+') AS hexa FROM $geoms""",
)
def is_hex_wkb(spark, sf):
    return _geoms(spark, sf).select("id", G.is_hex_wkb("actual").alias("hexa"))


@query(
    "decode_geom",
    "O68",
    """SELECT id, CASE id % 7 WHEN 0 THEN 'POINT(' || x || '.0 ' || y || '.0)' WHEN 1 THEN 'POINT(' || x || '.0 ' || y || '.0)' WHEN 2 THEN 'POINT(' || x || '.0 ' || y || '.0 5.0)'
  WHEN 3 THEN 'POINT EMPTY' WHEN 4 THEN 'POINT(' || x || '.0 ' || y || '.000001)' WHEN 5 THEN 'POINT(3.0 4.0)' END AS shown FROM $geoms""",
)
def decode_geom(spark, sf):
    decoded = _geoms(spark, sf).withColumn("w", G.decode_geom("actual"))
    shown = F.when(F.col("w").endswith("EMPTY"), F.col("w")).otherwise(G.canonical_text("w"))
    return decoded.select("id", F.replace(shown, F.lit("1.0E-6"), F.lit("0.000001")).alias("shown"))


def _both(spark, sf):
    return _geoms(spark, sf).withColumns(
        {"a": G.decode_geom("expected"), "b": G.decode_geom("actual")}
    )


@query("ewkt_equal", "O69", "SELECT id, id % 7 IN (0, 1) OR (id % 7 = 5 AND x = 3 AND y = 4) AS same FROM $geoms")
def ewkt_equal(spark, sf):
    return _both(spark, sf).select("id", G.ewkt_equal("a", "b").alias("same"))


@query("geom_equal", "O70", "SELECT id, id % 7 IN (0, 1, 2, 4) OR (id % 7 = 5 AND x = 3 AND y = 4) AS same FROM $geoms")
def geom_equal(spark, sf):
    return _both(spark, sf).select("id", G.geom_equal("a", "b").alias("same"))


@query(
    "shape_equal",
    "O70",
    """SELECT id, id % 3 <> 1 AS line_same, id % 3 <> 2 AS area_same FROM $shapes""",
)
def shape_equal(spark, sf):
    shapes = spread(from_view(spark, sf, "shapes"), "id").select(
        "id", *[G.decode_geom(c).alias(c) for c in ("line_a", "line_b", "area_a", "area_b")]
    )
    return shapes.select(
        "id",
        G.geom_equal("line_a", "line_b").alias("line_same"),
        G.geom_equal("area_a", "area_b").alias("area_same"),
    )


@query("z_equal", "O71", "SELECT id, id % 7 IN (0, 1, 4, 5) AS same FROM $geoms")
def z_equal(spark, sf):
    return _both(spark, sf).select(
        "id", G.z_equal(G.z_values("a"), G.z_values("b")).alias("same")
    )


@query("same_point_set", "O70", "SELECT id, id % 4 <> 2 AS line_same, id % 4 <> 2 AS area_same, false AS mixed FROM $shape_cuts")
def same_point_set(spark, sf):
    cells = ["line", "area", "line_cut", "area_cut"]
    cuts = from_view(spark, sf, "shape_cuts").select("id", *cells)
    # Cells repeat; each set of them is taken apart once, and each cell of it once.
    once = spread(cuts.select(*cells).distinct(), *cells)
    shapes = once.select(*cells, *[G.decode_geom(c).alias(f"{c}_wkt") for c in cells])
    shapes = shapes.select(*cells, *[G.snapped_form(f"{c}_wkt").alias(f"{c}_form") for c in cells])
    same = lambda a, b: F.coalesce(F.col(f"{a}_form") == F.col(f"{b}_form"), F.lit(False))
    verdicts = shapes.select(
        *[F.col(c).alias(f"_{c}") for c in cells],
        same("line", "line_cut").alias("line_same"),
        same("area", "area_cut").alias("area_same"),
        same("line", "area_cut").alias("mixed"),
    )
    joined = cuts.join(verdicts, F.expr(" AND ".join(f"{c} <=> _{c}" for c in cells)))
    return joined.select("id", "line_same", "area_same", "mixed")


@query(
    "decode_nested",
    "O68",
    """SELECT id, CASE WHEN whole THEN repeat('GEOMETRYCOLLECTION(', n) || 'LINESTRING(0.0 0.0 1.0,1.0 ' || id || '.0 2.0),' ||
  repeat('GEOMETRYCOLLECTION(POINT(1.0 2.0)),', n) || 'POINT(' || id || '.0 ' || n || '.0)' || repeat(')', n) END AS shown FROM $nested_geoms""",
)
def decode_nested(spark, sf):
    decoded = spread(from_view(spark, sf, "nested_geoms"), "id").withColumn("w", G.decode_geom("shape"))
    return decoded.select("id", G.canonical_text("w").alias("shown"))
