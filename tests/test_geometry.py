"""Decoding and shape equality against plain Python: binary cells, nesting, point sets."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from scoreframe.functions import geometry as G


def decoded(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i INT, v STRING").withColumn("w", G.decode_geom("v"))
    return [r.w for r in df.orderBy("i").collect()]


def forms(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i INT, v STRING").withColumn("w", G.decode_geom("v"))
    return [r.f for r in df.withColumn("f", G.snapped_form("w")).orderBy("i").collect()]


class Writer:
    """A random geometry as EWKB and as the WKT it stands for."""

    def __init__(self, r):
        self.r, self.order, self.iso = r, r.choice("<>"), r.random() < 0.5
        self.z, self.m = r.random() < 0.4, r.random() < 0.2

    def number(self):
        r = self.r
        return r.choice([0.0, -0.0, 1.5, -1e-7, 1e300, 5e-324, 2.2250738585072014e-308, math.pi, r.uniform(-180, 180), float(r.randint(-9, 9))])

    def position(self):
        return tuple(self.number() for _ in range(2 + self.z + self.m))

    def positions(self, least, ring=False):
        out = [self.position() for _ in range(self.r.randint(least, least + 3))]
        return [*out, out[0]] if ring else out

    def pack(self, points):
        return b"".join(struct.pack(f"{self.order}{len(p)}d", *p) for p in points)

    def text(self, points):
        return "(" + ", ".join(" ".join(map(repr, p)) for p in points) + ")"

    def count(self, n):
        return struct.pack(self.order + "I", n)

    def geometry(self, kind, nested=False, depth=0):
        r = self.r
        srid = not nested and not depth and r.random() < 0.3
        code = kind + 1000 * (self.z + 2 * self.m) if self.iso else kind | (0x80000000 * self.z) | (0x40000000 * self.m)
        code |= 0x20000000 * srid
        data = (b"\x01" if self.order == "<" else b"\x00") + self.count(code) + (self.count(4326) if srid else b"")
        if kind == 1:
            points = [self.position()]
            data, body = data + self.pack(points), self.text(points)
        elif kind == 2:
            points = self.positions(2)
            data, body = data + self.count(len(points)) + self.pack(points), self.text(points)
        elif kind == 3:
            rings = [self.positions(3, ring=True) for _ in range(r.randint(1, 3))]
            data += self.count(len(rings)) + b"".join(self.count(len(p)) + self.pack(p) for p in rings)
            body = "(" + ", ".join(map(self.text, rings)) + ")"
        else:
            members = [self.geometry(kind - 3 if kind < 7 else r.randint(1, 7 if depth < 3 else 6), kind < 7, depth + 1) for _ in range(r.randint(1, 3))]
            data += self.count(len(members)) + b"".join(d for d, _ in members)
            body = "(" + ", ".join(t for _, t in members) + ")"
        tag = " ZM" if self.z and self.m else " Z" if self.z else " M" if self.m else ""
        return data, body if nested else f"{G.WKB_NAMES[kind]}{tag} {body}"


def numbers(text):
    """Text with its numbers as floats, so that spellings agree."""
    import re

    return [float(t) if re.match(r"[-\d]", t) else t for t in re.findall(r"[-+\d.eE]+(?<!E)|[A-Z]+|[(),]", text)]


def test_binary_cells(spark):
    r = random.Random(1)
    made = [Writer(r).geometry(r.randint(1, 7)) for _ in range(300)]
    got = decoded(spark, [d.hex() if k % 2 else d.hex().upper() for k, (d, _) in enumerate(made)])
    assert [numbers(g or "") for g in got] == [numbers(t) for _, t in made]


def test_damaged_binary_cells(spark):
    r = random.Random(2)
    bad = []
    for _ in range(60):
        data = Writer(r).geometry(r.randint(1, 7))[0]
        bad += [data[:-1], data + b"\x00", data[: r.randint(8, len(data) - 1)], data[:1] + b"\x63\x00\x00\x63" + data[5:]]
    point = struct.pack("<BIdd", 1, 1, 1, 2)
    bad += [struct.pack("<BII", 1, 4, 4_000_000_000) + point, struct.pack("<BII", 1, 2, 0xFFFFFFFF), struct.pack("<BIdd", 1, 1, math.inf, 1)]
    got = decoded(spark, [b.hex() for b in bad])
    assert got == [None] * len(bad)
    assert decoded(spark, [point.hex() + "0", "1234567890123456", "", None]) == [None] * 4
    empty = [struct.pack("<BIdd", 1, 1, math.nan, math.nan), struct.pack("<BII", 1, 3, 0), struct.pack("<BII", 1, 7, 0)]
    assert decoded(spark, [e.hex() for e in empty]) == ["POINT EMPTY", "POLYGON EMPTY", "GEOMETRYCOLLECTION EMPTY"]


def test_long_binary_cell(spark):
    points = [(k / 7, -k / 3) for k in range(50_000)]
    data = struct.pack("<BII", 1, 2, len(points)) + b"".join(struct.pack("<dd", *p) for p in points)
    parts = struct.pack("<BII", 1, 5, 500) + b"".join(struct.pack("<BII", 1, 2, 2) + struct.pack("<4d", k, 0, k, 1) for k in range(500))
    line, many = decoded(spark, [data.hex(), parts.hex()])
    assert numbers(line) == numbers("LINESTRING (" + ", ".join(f"{x!r} {y!r}" for x, y in points) + ")")
    assert many.count("(") == 501


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("POINT(1 2)",)], "v STRING").withColumn("w", G.decode_geom("v")).withColumn("f", G.snapped_form("w"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_nesting_of_any_depth(spark):
    deep = ["GEOMETRYCOLLECTION(" * n + "POINT(1 2)" + ")" * n for n in (1, 4, 5, 50, 400)]
    wide = "GEOMETRYCOLLECTION(" + ",".join(f"GEOMETRYCOLLECTION Z (POINT Z ({k} 2 3), GEOMETRYCOLLECTION EMPTY)" for k in range(300)) + ")"
    good = [*deep, wide, "GEOMETRYCOLLECTION(GEOMETRYCOLLECTION(POLYGON((0 0,1 0,1 1,0 0)),MULTIPOINT(1 2,3 4)))"]
    assert all(w is not None for w in decoded(spark, good))
    bad = [t[:-1] for t in good] + [t + ")" for t in good] + [t.replace("POINT(1 2)", "POINT(1)") for t in deep] + [t.replace("(P", "(,P") for t in deep]
    bad += ["GEOMETRYCOLLECTION(POINT(1 2)POINT(1 2))", "\ue010", "GEOMETRYCOLLECTION(\ue010)", "GEOMETRYCOLLECTION()", "XPOINT(1 2)", "POINT(1 2)POINT(1 2)"]
    assert decoded(spark, bad) == [None] * len(bad)


def subdivided(r, ring):
    """A closed ring with points added on its edges, from another start, maybe the other way round."""
    out = []
    for (x, y), (u, v) in zip(ring, ring[1:] + ring[:1]):
        out.append((x, y))
        cuts = sorted(r.sample(range(1, 8), r.randint(0, 3)))
        out += [(x + (u - x) * c / 8, y + (v - y) * c / 8) for c in cuts]
    k = r.randrange(len(out))
    out = out[k:] + out[:k]
    out = out[::-1] if r.random() < 0.5 else out
    return [*out, out[0]]


def ring_text(points):
    return "(" + ",".join(f"{x!r} {y!r}" for x, y in points) + ")"


def test_rings_with_points_on_their_edges(spark):
    r = random.Random(3)
    values, pairs = [], []
    for _ in range(80):
        # Corners on a circle make a simple ring; coordinates are multiples of 8 cells, so cuts lie on the grid.
        ring = [(round(math.cos(a) * 1000) * 8e-5, round(math.sin(a) * 1000) * 8e-5) for a in sorted({r.randint(0, 999) * math.tau / 1000 for _ in range(r.randint(4, 9))})]
        if len(ring) < 3:
            continue
        other = list(ring)
        other[0] = (other[0][0] + 8e-5, other[0][1])
        base = len(values)
        values += ["POLYGON(" + ring_text([*ring, ring[0]]) + ")", "POLYGON(" + ring_text(subdivided(r, ring)) + ")", "POLYGON(" + ring_text([*other, other[0]]) + ")"]
        pairs.append(base)
    f = forms(spark, values)
    assert all(f[k] is not None and f[k] == f[k + 1] and f[k] != f[k + 2] for k in pairs)


def cover(parts):
    """Unit edges of a lattice that lines along its axes and diagonals cover."""
    out = set()
    for part in parts:
        for (x, y), (u, v) in zip(part, part[1:]):
            n = max(abs(u - x), abs(v - y))
            dx, dy = (u - x) // n if n else 0, (v - y) // n if n else 0
            for k in range(n):
                a, b = (x + k * dx, y + k * dy), (x + (k + 1) * dx, y + (k + 1) * dy)
                out.add((min(a, b), max(a, b)))
    return frozenset(out)


def test_lines_as_point_sets(spark):
    r = random.Random(4)
    made = []
    for _ in range(400):
        parts = []
        for _ in range(r.randint(1, 3)):
            part = [(r.randint(0, 2), r.randint(0, 2))]
            for _ in range(r.randint(1, 3)):
                (x, y), (dx, dy), n = part[-1], r.choice([(1, 0), (0, 1), (1, 1), (1, -1), (-1, 0)]), r.randint(0, 2)
                part.append((x + n * dx, y + n * dy))
            parts.append(part)
        made.append(parts)
    f = forms(spark, ["MULTILINESTRING(" + ",".join(ring_text(p) for p in parts) + ")" for parts in made])
    covers = [cover(parts) for parts in made]
    same = 0
    for i in range(len(made)):
        for j in range(i):
            assert (f[i] == f[j]) == (covers[i] == covers[j]), (made[i], made[j])
            same += covers[i] == covers[j]
    assert same > 100


def cells_of(rects):
    """Unit squares that an odd number of rectangles cover."""
    out = set()
    for x, y, u, v in rects:
        out ^= {(i, j) for i in range(x, u) for j in range(y, v)}
    return frozenset(out)


def test_areas_cut_into_parts(spark):
    """Rectangles side by side are the area they cover, whatever the cut."""
    r = random.Random(5)
    made = []
    for _ in range(200):
        rects, x = [], 0
        for _ in range(r.randint(1, 3)):
            x += r.randint(0, 1)
            u, top = x + r.randint(1, 2), r.randint(1, 2)
            rects += [(x, 0, u, top)] if r.random() < 0.5 or top == 1 else [(x, 0, u, 1), (x, 1, u, 2)]
            x = u
        made.append(rects)
    text = lambda x, y, u, v: "(" + ring_text([(x, y), (u, y), (u, v), (x, v), (x, y)]) + ")"
    f = forms(spark, ["MULTIPOLYGON(" + ",".join(text(*q) for q in rects) + ")" for rects in made])
    covers = [cells_of(rects) for rects in made]
    for i in range(len(made)):
        for j in range(i):
            assert (f[i] == f[j]) == (covers[i] == covers[j]), (made[i], made[j])


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))", "POLYGON((4 4,0 4,0 0,2 0,4 0,4 4),(2 2,1 2,1 1,1.5 1,2 1,2 2))", True),
        ("POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))", "POLYGON((0 0,4 0,4 4,0 4,0 0))", False),
        ("LINESTRING(0 0,1 0,1 1,0 1,0 0)", "POLYGON((0 0,1 0,1 1,0 1,0 0))", False),
        ("LINESTRING(0 0,5 0.000001,10 0)", "LINESTRING(0 0,10 0)", True),
        ("LINESTRING(0 0,5 0.0001,10 0)", "LINESTRING(0 0,10 0)", False),
        ("LINESTRING(0 0,2 0,1 0,3 0)", "LINESTRING(3 0,0 0)", True),
        ("GEOMETRYCOLLECTION(LINESTRING(0 0,1 1),GEOMETRYCOLLECTION(LINESTRING(2 2,1 1),POINT(5 5)))", "GEOMETRYCOLLECTION(POINT(5 5),LINESTRING(2 2,0 0))", True),
        ("LINESTRING(-179.123456 -89.5,179.654321 89.25)", "MULTILINESTRING((-179.123456 -89.5,179.654321 89.25),(179.654321 89.25,-179.123456 -89.5))", True),
        ("LINESTRING(500000.12345 6000000.1,500000.12347 6000000.10002)", "LINESTRING(500000.12345 6000000.1,500000.12346 6000000.10001,500000.12347 6000000.10002)", True),
        ("POINT(1e20 1)", "POINT(1e20 1)", None),
        ("POINT EMPTY", "POINT EMPTY", True),
        ("nothing", "nothing", None),
    ],
)
def test_pairs(spark, a, b, same):
    f, g = forms(spark, [a, b])
    assert (f is None and g is None) if same is None else (f == g) == same
    df = spark.createDataFrame([(a, b)], "a STRING, b STRING").withColumns({c: G.decode_geom(c) for c in "ab"})
    assert df.select(G.geom_equal("a", "b").alias("e"), G.geom_equal("b", "a").alias("r")).first() == (bool(same), bool(same))
    assert df.where(F.col("a").isNull() & F.lit(same is not None)).count() == 0


def test_collections_with_blanks_and_broken_ones(spark):
    """Blanks stand before and behind commas and before closing parentheses; each broken text stays null."""
    good = ["GEOMETRYCOLLECTION ( POINT(1 2) , GEOMETRYCOLLECTION Z( POINT(1 2 3) ,\tLINESTRING(0 0,1 1) ) )", "GeometryCollection(GEOMETRYCOLLECTION EMPTY)"]
    bad = [
        "GEOMETRYCOLLECTION(POINT(1 2),)", "GEOMETRYCOLLECTION( )", "GEOMETRYCOLLECTION(,POINT(1 2))", "GEOMETRYCOLLECTION(POINT(1 2)) ,",
        "GEOMETRYCOLLECTION(POINT(1 2) POINT(1 2))", "XGEOMETRYCOLLECTION(POINT(1 2))", "GEOMETRYCOLLECTION(POINT(1 2)))", "POINT(1 2))", "GEOMETRYCOLLECTION()",
    ]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(good + bad)], "i INT, v STRING").withColumn("w", G.decode_geom("v"))
    assert [r.w is not None for r in df.orderBy("i").collect()] == [True] * len(good) + [False] * len(bad)


def test_canonical_text_reads_values_only(spark):
    """Words are no numbers; NaN and infinities are, as are numbers with signs and exponents."""
    df = spark.createDataFrame([("GEOMETRYCOLLECTION( POINT Z (1 -2e3 .5),MULTIPOINT((1 +2), (3 4)), POINT(NAN INF), POINT EMPTY)",)], "w STRING")
    assert df.select(G.canonical_text("w")).first()[0] == (
        "GEOMETRYCOLLECTION(POINT(1.0 -2000.0 0.5),MULTIPOINT((1.0 2.0),(3.0 4.0)),POINT(NaN Infinity),POINT EMPTY)"
    )


def test_snapping_rounds_halves_away_from_zero(spark):
    pairs = [("POINT(0.5 -0.5)", "POINT(1 -1)", True), ("POINT(2.5 1.4999)", "POINT(3 1)", True), ("POINT(0.49999999999999994 0)", "POINT(0 0)", True),
             ("LINESTRING(0 0,999999999999 999999999999)", "LINESTRING(999999999999 999999999999,0 0,5 5)", True),
             ("LINESTRING(-900000000000 7,900000000000 8)", "LINESTRING(-900000000000 8,900000000000 9)", False), ("POINT(1e15 0)", "POINT(1e15 0)", False)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "i INT, a STRING, b STRING, want BOOLEAN")
    got = df.withColumn("same", G.geom_equal("a", "b", 1.0)).orderBy("i").collect()
    assert [r.same for r in got] == [r.want for r in got]


def test_no_error_per_word(spark):
    """A cast of a word throws and catches an error; only values are cast."""
    words = "GEOMETRYCOLLECTION(" * 3 + "POINT(1.5 2)" + ")" * 3
    df = spark.createDataFrame([(words,)], "w STRING").select(F.regexp_extract_all("w", F.lit(G._VALUE), F.lit(0)).alias("n"))
    assert df.first().n == ["1.5", "2"]


def test_heavy_queries_use_all_cores(spark):
    """A table in one file is dealt over many tasks before its cells are taken apart."""
    from scoreframe.catalog import load_all
    from tests.oracle import DATA

    for name in ("decode_nested", "same_point_set", "shape_equal"):
        df = load_all()[name].run(spark, f"{DATA}/sf0.001")
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().toString(), name
