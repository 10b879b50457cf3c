"""Geometry cells: recognition, decoding and comparison, as column expressions.

A cell is turned into WKT text (binary cells byte by byte, on the JVM), its numbers are written in one
form, and the comparisons work on arrays of grid cells. Shapes are equal as sets of points: extra
vertices on an edge, the direction and start of a ring, and the split into parts make no difference.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sqltext import let as sql_let
from .sqltext import running_sums, stripped
from .text import let, strip

_KINDS = "POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON|GEOMETRYCOLLECTION"

# The text shape of a geometry cell.
WKT_PATTERN = (
    r"\A(SRID=\d+;)?(POINT|LINESTRING|POLYGON|MULTI(POINT|LINESTRING|POLYGON)?|GEOMETRYCOLLECTION)"
    r"( Z| M| ZM)?\s*\(.*\)"
)
HEX_WKB_PATTERN = r"\A[0-9A-Fa-f]{16,}\z"

# Geometry type codes of the binary form.
WKB_NAMES = {
    1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT",
    5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_wkt(c: Column | str) -> Column:
    """Text form with optional SRID; EMPTY has no parentheses and does not count."""
    return F.coalesce(F.regexp_like(F.upper(strip(_col(c))), F.lit(WKT_PATTERN)), F.lit(False))


def is_hex_wkb(c: Column | str) -> Column:
    """At least 16 hex digits and nothing else (long decimal ids match as well)."""
    return F.coalesce(F.regexp_like(_col(c), F.lit(HEX_WKB_PATTERN)), F.lit(False))


def is_geometry(c: Column | str) -> Column:
    return is_wkt(c) | is_hex_wkb(c)


# The expressions below are SQL text: they are long, and one parse builds them far
# faster than call by call. {c} is the column, {grid} the grid size. The idiom
# get(transform(array(x), v -> ...), 0) works x out once.

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:E[+-]?\d+)?"
_TUPLE = rf"{_NUMBER}(?:\s+{_NUMBER}){{1,3}}"
_DIMS = r"(?:\s*(?:ZM|Z|M))?"


def _list_of(item: str, least: int = 1) -> str:
    """Items in parentheses with commas between them; possessive, so a long text needs no stack."""
    return rf"\(\s*(?:{item}\s*(?:,(?!\s*\))\s*|(?=\)))){{{least},}}+\)"


_LINE, _RING_TEXT = _list_of(_TUPLE, 2), _list_of(_TUPLE, 4)
_AREA = _list_of(_RING_TEXT)
_BODIES = {
    "POINT": rf"\(\s*{_TUPLE}\s*\)",
    "LINESTRING": _LINE,
    "POLYGON": _AREA,
    "MULTIPOINT": _list_of(rf"(?:{_TUPLE}|\(\s*{_TUPLE}\s*\))"),
    "MULTILINESTRING": _list_of(_LINE),
    "MULTIPOLYGON": _list_of(_AREA),
}
# A whole member that holds no other one. Marks stand for members that are whole.
_MEMBER = (
    "(?<![A-Z])(?:" + "|".join(rf"{k}{_DIMS}\s*{body}" for k, body in _BODIES.items()) + rf"|(?:{_KINDS}){_DIMS}\s+EMPTY)"
)
_MARK = "\ue010"
_OPEN = "\ue011"
_HEAD = rf"GEOMETRYCOLLECTION{_DIMS}\s*\(\s*"
_COLLECTION = rf"{_OPEN}{_MARK}(?:,{_MARK})*+\)"
_LEAF = (
    r"(?:MULTI)?(?:POINT|LINESTRING|POLYGON)(?:\s*(?:ZM|Z|M))?\s*"
    r"\((?:[^()]|\((?:[^()]|\([^()]*\))*+\))*+\)"
)


def _sql(text: str, name: str, **parts: object) -> Column:
    for key, value in {"c": f"`{name}`", **parts}.items():
        text = text.replace("{" + key + "}", str(value))
    return F.expr(text)


#: Steps of a block of the fold below.
_STEPS = 256


def _wkb_text(c: str) -> str:
    """SQL for the WKT of a hex (E)WKB value: a fold over a stack of members that are still to be read.

    A frame says how many items are left and what they are: rings (0), members without a name (1) or
    with one (2). A step reads one item or closes a frame, and notes what to write: a text and where the
    positions behind it lie (n of them; -1 for a point, 0 for none). A fold copies its state at every step, so
    positions are read afterwards, and steps are taken in blocks with notes of their own. Null unless the bytes are used up
    exactly.
    """
    names = ", ".join(f"'{WKB_NAMES[k]}'" for k in sorted(WKB_NAMES))
    frame = "STRUCT<left: INT, mode: INT, le: BOOLEAN, dims: INT, first: BOOLEAN>"

    def swapped(text: str, le: str, size: int) -> str:
        groups, back = "(..)" * size, "".join(f"${k}" for k in range(size, 0, -1))
        return f"IF({le}, regexp_replace({text}, '{groups}', '{back}'), {text})"

    def count(le: str, at: str) -> str:
        return f"CAST(conv({swapped(f'hex(substring(b, {at} + 1, 4))', le, 4)}, 16, 10) AS BIGINT)"

    # A double from its bits; every step is exact.
    fraction = "CAST(conv(substr(h, 4), 16, 10) AS BIGINT) / 4503599627370496D"
    double = sql_let(
        "CAST(conv(substr(h, 1, 3), 16, 10) AS INT)",
        "e",
        f"IF(e % 2048 = 2047, 'NAN', string((IF(e >= 2048, -1D, 1D) * (IF(e % 2048 = 0, 0D, 1D) + {fraction})) "
        "* power(2D, greatest(e % 2048, 1) - 1023)))",
    )

    def points(at: str, n: str, le: str, dims: str) -> str:
        run = f"hex(substring(b, int({at}) + 1, int({n} * {dims} * 8)))"
        values = f"transform(regexp_extract_all({swapped(run, le, 8)}, '.{{16}}', 0), h -> {double})"
        return sql_let(values, "v", f"array_join(transform(sequence(0, int({n}) - 1), i -> array_join(transform(sequence(0, {dims} - 1), j -> get(v, i * {dims} + j)), ' ')), ', ')")

    fail = "named_struct('at', s.at, 'st', s.st, 'out', s.out, 'ok', false)"
    below = "slice(s.st, 1, size(s.st) - 1)"
    rest = f"concat({below}, array(named_struct('left', top.left - 1, 'mode', top.mode, 'le', top.le, 'dims', top.dims, 'first', false)))"

    def note(text: str, at: str = "0", n: str = "0", dims: str = "0", le: str = "true") -> str:
        return f"named_struct('text', {text}, 'at', int({at}), 'n', int({n}), 'dims', int({dims}), 'le', {le})"

    def done(at: str, written: str, stack: str = rest) -> str:
        return f"named_struct('at', int({at}), 'st', {stack}, 'out', concat(s.out, array({written})), 'ok', true)"

    sep = "IF(top.first, '', ', ')"
    ring = sql_let(
        count("top.le", "s.at"),
        "n",
        f"IF(n IS NULL OR n = 0 OR s.at + 4 + n * top.dims * 8 > length(b), {fail}, "
        + done("s.at + 4 + n * top.dims * 8", note(sep, "s.at + 4", "n", "top.dims", "top.le"))
        + ")",
    )
    pushed = f"concat({rest}, array(named_struct('left', int(n), 'mode', CASE k WHEN 3 THEN 0 WHEN 7 THEN 2 ELSE 1 END, 'le', le, 'dims', d, 'first', true)))"
    several = sql_let(
        count("le", "p"),
        "n",
        f"CASE WHEN n IS NULL OR p + 4 > length(b) THEN {fail} "
        f"WHEN n = 0 THEN {done('p + 4', note("concat(lead, 'EMPTY')"))} "
        f"WHEN k > 2 THEN IF(n * 4 > length(b) - p - 4, {fail}, {done('p + 4', note("concat(lead, '(')"), pushed)}) "
        f"WHEN p + 4 + n * d * 8 > length(b) THEN {fail} "
        f"ELSE {done('p + 4 + n * d * 8', note('lead', 'p + 4', 'n', 'd', 'le'))} END",
    )
    body = (
        f"CASE WHEN k < 1 OR k > 7 OR iso > 3 THEN {fail} WHEN k > 1 THEN {several} WHEN p + d * 8 > length(b) THEN {fail} "
        f"ELSE {done('p + d * 8', note('lead', 'p', '-1', 'd', 'le'))} END"
    )
    tag = f"concat(element_at(array({names}), k), IF(z, ' Z', ''), IF(m, IF(z, 'M', ' M'), ''), ' ')"
    lead = f"concat({sep}, IF(top.mode = 1 OR k < 1 OR k > 7, '', {tag}))"
    # In the order they are worked out: each value may use those before it.
    header = body
    for name, value in (
        ("lead", lead),
        ("d", "2 + int(z) + int(m)"),
        ("p", "s.at + 5 + IF(code & 536870912 > 0, 4, 0)"),
        ("m", "code & 1073741824 > 0 OR iso IN (2, 3)"),
        ("z", "code & 2147483648 > 0 OR iso IN (1, 3)"),
        ("iso", "int((code & 268435455) div 1000)"),
        ("k", "int((code & 268435455) % 1000)"),
        ("code", count("le", "s.at + 1")),
        ("le", "hex(substring(b, s.at + 1, 1)) = '01'"),
    ):
        header = sql_let(value, name, header)
    end = note("IF(size(s.st) = 1, '', ')')")
    step = sql_let(
        "element_at(s.st, -1)",
        "top",
        f"CASE WHEN top.left = 0 THEN {done('s.at', end, below)} WHEN s.at + IF(top.mode = 0, 4, 9) > length(b) THEN {fail} "
        f"WHEN top.mode = 0 THEN {ring} ELSE {header} END",
    )
    notes = "CAST(array() AS ARRAY<STRUCT<text: STRING, at: INT, n: INT, dims: INT, le: BOOLEAN>>)"
    first = "named_struct('left', 1, 'mode', 2, 'le', true, 'dims', 2, 'first', true)"
    start = f"named_struct('at', 0, 'st', CAST(array({first}) AS ARRAY<{frame}>), 'out', {notes}, 'ok', true)"
    over = "NOT {0}.ok OR size({0}.st) = 0"
    block = (
        f"aggregate(sequence(1, {_STEPS}), named_struct('at', o.at, 'st', o.st, 'out', {notes}, 'ok', true), "
        f"(s, _) -> IF({over.format('s')}, s, {step}))"
    )
    joined = sql_let(block, "s", "named_struct('at', s.at, 'st', s.st, 'out', concat(o.out, s.out), 'ok', s.ok)")
    # Every member or ring has four bytes of its own, and closes once.
    fold = f"aggregate(sequence(0, length(b) div {2 * _STEPS}), {start}, (o, _) -> IF({over.format('o')}, o, {joined}))"
    read = sql_let(points("x.at", "abs(x.n)", "x.le", "x.dims"), "q", "IF(x.n < 0 AND regexp_like(q, 'NAN( NAN)+'), 'EMPTY', concat('(', q, ')'))")
    told = f"transform(r.out, x -> IF(x.n = 0, x.text, concat(x.text, {read})))"
    whole = sql_let(fold, "r", f"IF(r.ok AND size(r.st) = 0 AND r.at = length(b), array_join({told}, ''), NULL)")
    return f"IF(length({c}) % 2 = 0, {sql_let(f'unhex({c})', 'b', whole)}, NULL)"


def decode_geom(name: str) -> Column:
    """Upper-case WKT of a column of geometry cells without SRID; null where a cell cannot be decoded.

    A point has one position, a line at least two, a ring at least four and ends where it starts;
    the members of a collection, nested to any depth, must be whole as well. Every geometry is taken as SRID 4326. A
    binary point without numbers is EMPTY.
    """
    # The value is trimmed and recognised once; a trim walks the whole text.
    text = sql_let(
        stripped(f"`{name}`"),
        "hx",
        rf"IF(regexp_like(hx, r'{HEX_WKB_PATTERN}'), {_wkb_text('hx')}, regexp_replace(upper(hx), r'\ASRID=\d+;\s*', ''))",
    )
    return let(F.expr(text), lambda t: F.when(_whole(t) & _rings_closed(t), t))


def _whole(t: Column) -> Column:
    """Whether a text is one geometry: whole members become marks, and so do collections of marks, from
    the inside out, until nothing changes."""
    marked = F.regexp_replace(t, _MEMBER, _MARK)

    def short(m: Column) -> Column:
        """One character for the head of a collection, no blanks where they may stand: each step reads less."""
        return F.regexp_replace(F.regexp_replace(m, _HEAD, _OPEN), r"\s*([,)])\s*(?![^,)])", "$1")

    def reduced(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(
            let(F.regexp_replace(s["t"], _COLLECTION, _MARK), lambda r: F.struct(r.alias("t"), (r == s["t"]).alias("done")))
        )

    def folded(m: Column) -> Column:
        start = F.struct(m.alias("t"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(0), F.size(F.split(m, _OPEN))), start, reduced)["t"]

    collected = let(marked, lambda m: F.when(m == _MARK, m).otherwise(let(short(m), folded)))
    return ~t.contains(_MARK) & ~t.contains(_OPEN) & (collected == _MARK)


def _rings_closed(t: Column) -> Column:
    """Every ring of every polygon ends at the point it starts from."""

    def point(p: Column) -> Column:
        return F.transform(F.split(F.trim(p), r"\s+"), lambda v: v.try_cast("double"))

    def closed(ring: Column) -> Column:
        return let(F.split(ring, ","), lambda ps: point(ps[0]) == point(F.element_at(ps, -1)))

    def whole(m: Column) -> Column:
        return ~m.contains("POLYGON") | F.forall(F.regexp_extract_all(m, F.lit(r"\(([^()]+)\)"), 1), closed)

    return ~t.contains("POLYGON") | F.forall(F.regexp_extract_all(t, F.lit(_LEAF), 0), whole)


# What stands between blanks, commas and parentheses, but is no word; a cast of every word would
# throw and catch an error each.
_VALUE = r"(?<![^(), ])(?!(?!NAN|INF)[A-Z]++(?![^(), ]))[^(), ]++"

_CANONICAL = sql_let(
    r"regexp_replace(regexp_replace(regexp_replace({c}, r'\s+', ' '), r'(?<=[A-Z])\s*(?:ZM|Z)(?=\s*\()', ''), r'\s*([(),])\s*', '$1')",
    "t",
    sql_let(
        f"array_join(zip_with(split(t, r'{_VALUE}', -1), regexp_extract_all(t, r'{_VALUE}', 0), "
        "(g, n) -> IF(n IS NULL, g, concat(g, coalesce(string(try_cast(n AS DOUBLE)), n)))), '')",
        "j",
        r"CASE WHEN startswith(j, 'MULTIPOINT') THEN regexp_replace(regexp_replace(j, r'\),\(', ','), r'\(\((.*)\)\)', '($1)') ELSE j END",
    ),
)


def canonical_text(name: str) -> Column:
    """Decoded WKT in one spelling: no Z tag (the third number says it), plain numbers,
    no blanks, and points of a MULTIPOINT without parentheses of their own."""
    return _sql(_CANONICAL, name)


_GROUPS = r"regexp_extract_all(m, r'\(([^()]+)\)', 1)"

# Grid cells of one coordinate list g, rounded half away from zero; a number beyond the grid makes
# the whole form null.
_CELLS = r"""
transform(transform(regexp_extract_all(g, r'([^\s,]++)\s++([^\s,]++)[^,]*+', {n}), t -> try_cast(t AS DOUBLE) / {grid}D),
  v -> IF(abs(rint(v)) < 1e15D, bigint(IF(abs(v - rint(v)) = 0.5D, v + 0.5D * signum(v), rint(v))), NULL))
"""
_SNAP = f"zip_with({_CELLS.replace('{n}', '1')}, {_CELLS.replace('{n}', '2')}, (x, y) -> named_struct('x', x, 'y', y))"

_GCD = """
aggregate(
  sequence(1, IF(dx = 0 OR dy = 0, 1, int(3 + 2.1 * ln(double(greatest(dx, abs(dy))))))),
  named_struct('a', dx, 'b', abs(dy)),
  (s, _) -> IF(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> IF(s.b = 0, s.a, s.b))
"""

# The cross product of a direction (ux, uy) and the point it starts from, as text.
_CROSS = (
    "IF(abs(double(ux) * double(e.ly)) < 2e18D AND abs(double(uy) * double(e.lx)) < 2e18D, string(ux * e.ly - uy * e.lx), "
    "string(CAST(ux AS DECIMAL(16, 0)) * CAST(e.ly AS DECIMAL(16, 0)) - CAST(uy AS DECIMAL(16, 0)) * CAST(e.lx AS DECIMAL(16, 0))))"
)

# The stretches between neighbours of a list s of cells: the straight line each lies on, as its reduced
# direction (ux, uy) and its cross product with any point of the line, and the two ends in order. Texts
# and numbers lie side by side, because an order of structs inside structs is built anew at every comparison.
_STRETCHES = f"""
transform(
  filter(zip_with(slice(s, 1, greatest(size(s) - 1, 0)), slice(s, 2, greatest(size(s) - 1, 0)),
                  (p, q) -> IF(p.x < q.x OR p.x = q.x AND p.y < q.y, named_struct('lx', p.x, 'ly', p.y, 'hx', q.x, 'hy', q.y),
                               named_struct('lx', q.x, 'ly', q.y, 'hx', p.x, 'hy', p.y))), e -> e.lx <> e.hx OR e.ly <> e.hy),
  e -> {sql_let("e.hx - e.lx", "dx", sql_let("e.hy - e.ly", "dy", sql_let(_GCD, "k", sql_let(
      "dx div k", "ux", sql_let("dy div k", "uy",
      f"named_struct('line', concat_ws(' ', ux, uy, {_CROSS}), 'lx', e.lx, 'ly', e.ly, 'hx', e.hx, 'hy', e.hy)")))))})
"""

# Covered by any stretch: ends in order along each line, starts first, kept where the first stretch
# begins or the last one ends. Stretches that touch or overlap become one.
_UNION = sql_let(
    "sort_array(flatten(transform(es, e -> array(named_struct('line', e.line, 'x', e.lx, 'y', e.ly, 'close', 0), "
    "named_struct('line', e.line, 'x', e.hx, 'y', e.hy, 'close', 1)))))",
    "ends",
    sql_let(
        "transform(ends, e -> IF(e.close = 0, 1, -1))",
        "signs",
        f"transform(filter(zip_with(ends, {running_sums('signs')}, (e, d) -> named_struct('e', e, 'edge', d = 1 - e.close)), "
        "o -> o.edge), o -> o.e)",
    ),
)

# The edge of an area: what an odd number of rings run along. An end that two stretches of one line
# share cancels out, and so does an edge between two parts.
_BORDER = sql_let(
    "sort_array(flatten(transform(es, e -> array(concat_ws(' ', e.line, e.lx, e.ly), concat_ws(' ', e.line, e.hx, e.hy)))))",
    "ends",
    sql_let(
        "filter(sequence(0, size(ends)), i -> i = 0 OR i = size(ends) OR get(ends, i) <> get(ends, i - 1))",
        "runs",
        "transform(filter(zip_with(slice(runs, 1, size(runs) - 1), slice(runs, 2, size(runs)), "
        "(i, j) -> named_struct('i', i, 'n', j - i)), r -> r.n % 2 = 1), r -> get(ends, r.i))",
    ),
)

_LISTS = r"transform(flatten(transform(filter(ms, m -> contains(substring_index(m, '(', 1), '{kind}')), m -> {groups})), g -> {snap})"

_SHAPE = sql_let(
    "regexp_extract_all({c}, r'{leaf}', 0)",
    "ms",
    sql_let(
        "array({points}, {lines}, {rings})",
        "all",
        "IF({c} IS NULL OR exists(all, part -> exists(part, g -> exists(g, p -> p.x IS NULL OR p.y IS NULL))), NULL, "
        "concat_ws('/', string(sort_array(array_distinct(flatten(get(all, 0))))), "
        + f"IF(size(get(all, 1)) = 0, '[]', {sql_let('flatten(transform(get(all, 1), s -> {stretches}))', 'es', f'string({_UNION})')})"
        + ", "
        + f"IF(size(get(all, 2)) = 0, '[]', {sql_let('flatten(transform(get(all, 2), s -> {stretches}))', 'es', f'string({_BORDER})')})"
        + "))",
    ),
)


def snapped_form(name: str, grid: float = 1e-5) -> Column:
    """The decoded shape on the grid as a set of points, in a normal form, as text.

    Points become a sorted set. Lines become the longest straight stretches they cover, however they are
    cut, directed or repeated; a line within one cell covers nothing. An area becomes the longest
    straight stretches of its border, so that neither the vertices on an edge, nor where a ring starts and
    how it turns, nor a cut into parts matters. Single and multi types agree. Null for numbers of 10^15 cells or more.
    """
    lists = {part: _LISTS.replace("{kind}", kind) for part, kind in (("points", "POINT"), ("lines", "LINESTRING"), ("rings", "POLYGON"))}
    text = _SHAPE
    for part, value in {**lists, "stretches": _STRETCHES, "snap": _SNAP, "groups": _GROUPS}.items():
        text = text.replace("{" + part + "}", value)
    return _sql(text, name, leaf=_LEAF, grid=repr(float(grid)))


_Z = r"""
transform(
  flatten(transform(regexp_extract_all({c}, r'\(([^()]+)\)', 1), g -> split(g, ','))),
  p -> CASE WHEN NOT regexp_like({c}, r'[A-Z]\s*M\s*\(')
            THEN try_cast(get(split(trim(p), r'\s+'), 2) AS DOUBLE) END)
"""


def z_values(name: str) -> Column:
    """Z of every point in text order; null entries for points in the plane."""
    return _sql(_Z, name)


def ewkt_equal(a: str, b: str) -> Column:
    """Same geometry text, whatever the spelling, of two decoded columns."""
    return F.coalesce(canonical_text(a) == canonical_text(b), F.lit(False))


def geom_equal(a: str, b: str, grid: float = 1e-5) -> Column:
    """Same shape in the plane after snapping to the grid, of two decoded columns."""
    return F.coalesce(snapped_form(a, grid) == snapped_form(b, grid), F.lit(False))


def z_equal(za: Column | str, zb: Column | str, tol: float = 1e-6) -> Column:
    """Same number of points and the same Z point by point; two missing Z agree.

    Takes two arrays from :func:`z_values`.
    """
    za, zb = _col(za), _col(zb)
    close = F.zip_with(
        za,
        zb,
        lambda x, y: (x.isNull() & y.isNull())
        | F.coalesce(F.abs(x - y) <= tol, F.lit(False)),
    )
    return F.coalesce(
        (F.size(za) == F.size(zb)) & (F.size(za) > 0) & F.forall(close, lambda ok: ok),
        F.lit(False),
    )


def text_equal(a: Column | str, b: Column | str) -> Column:
    """Same text apart from case and blanks around it; two NULLs agree."""
    return F.lower(strip(_col(a).cast("string"))).eqNullSafe(
        F.lower(strip(_col(b).cast("string")))
    )
