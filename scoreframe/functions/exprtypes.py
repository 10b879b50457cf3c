"""The type of an SQL expression read from its text, from the inside out, as SQL of a column expression.

Literals become atoms, which are types between two private-use characters; names that no table stands behind
become the atom ``?``. Then every innermost group of parentheses is replaced by the atom of its type, all
of one depth at a time, until no group is left: a call has the type of its best overload, a group that of the
operators between its atoms. A cast binds to the atom in front of it, and the last one counts.
"""

from __future__ import annotations

from .sqltext import let, literal_type, retold, stripped, type_name

# Private-use characters around an atom and around the type of a cast, and for a blank within a type.
_A, _Z, _CAST, _END, _BLANK = "\ue020", "\ue021", "\ue022", "\ue023", "\ue024"
_ATOM = f"{_A}[^{_Z}]*{_Z}"

# Types of two words and more by the short name they are known by.
_LONG_NAMES = {
    r"double\s+precision": "float8", r"character\s+varying": "varchar", r"timestamp(?:\s*\(\d+\))?\s+with\s+time\s+zone": "timestamptz",
    r"timestamp(?:\s*\(\d+\))?\s+without\s+time\s+zone": "timestamp", r"time\s+without\s+time\s+zone": "time",
}
# Types that may stand in front of a quoted text.
_QUOTED = "date|time|timestamptz|timestamp|interval|geometry|geography|box2d|box3d|box|point|jsonb|json|uuid|bytea|text|varchar|float8|int|integer|numeric|bit"
# Words that are no names of columns.
_WORDS = (
    "and|or|not|in|is|like|ilike|between|similar|to|case|when|then|else|end|array|any|all|some|exists|distinct|from|collate|at|zone|over|"
    "symmetric|escape|as|isnull|notnull|cast"
)
# Words whose parentheses hold an operand and not arguments.
_BEFORE_GROUP = "and|or|not|is|like|ilike|between|similar|to|case|when|then|else|distinct|from"
# Numeric types, each of which gives way to those behind it.
_NUMERIC = "array('smallint', 'integer', 'bigint', 'numeric', 'real', 'double precision')"
_MOMENTS = "('timestamp without time zone', 'timestamp with time zone', 'date')"

_GROUP = r"([A-Za-z_][\w.]*)?\s*(?:\(([^()\[\]]*)\)|\[([^()\[\]]*)\])"


def _atom(value: str) -> str:
    return f"concat('{_A}', translate({value}, ' ', '{_BLANK}'), '{_Z}')"


def _replaced(t: str, pattern: str, by: str) -> str:
    return f"regexp_replace({t}, r'{pattern}', '{by}')"


def _atoms(a: str) -> str:
    """The text with literals, names and casts as atoms."""
    text = retold(a, f"CASE WHEN startswith(t, '\"') THEN '{_A}?{_Z}' ELSE '{_A}unknown{_Z}' END")
    for long, short in _LONG_NAMES.items():
        text = _replaced(text, rf"(?i)\b{long}\b", short)
    type_text = r"([A-Za-z_]\w*)(?:\s*\([^()]*\))?((?:\s*\[\s*\d*\s*\])*)"
    text = _replaced(text, rf"(?i)\b(?:e|u&)({_A}unknown{_Z})", "$1")
    text = _replaced(text, rf"(?i)\b[bx]{_A}unknown{_Z}", f"{_A}bit{_Z}")
    text = _replaced(text, rf"(?i)\b({_QUOTED})\s*{_A}unknown{_Z}", f"{_A}$1{_Z}")
    text = _replaced(text, rf"::\s*{type_text}", f"{_CAST}$1$2{_END}")
    text = _replaced(text, rf"(?i)\bas\s+{type_text}\s*\)", f"{_CAST}$1$2{_END})")
    # From here on a bracket within a cast would look like one of an array.
    text = _replaced(text, rf"\[\s*\d*\s*\](?=[^{_CAST}]*{_END})", "_array")
    number = r"(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+"
    text = _replaced(text, rf"(?<![\w.{_A}{_CAST}{_BLANK}])(?:{number})(?!\w)", f"{_A}numeric{_Z}")
    whole = rf"(?<![\w.{_A}{_CAST}{_BLANK}])\d+(?![\w.])"
    size = "try_cast(t AS DECIMAL(38, 0))"
    kind = f"CASE WHEN {size} <= 2147483647 THEN 'integer' WHEN {size} <= 9223372036854775807 THEN 'bigint' ELSE 'numeric' END"
    text = let(
        text,
        "u",
        f"array_join(zip_with(split(u, r'{whole}', -1), regexp_extract_all(u, r'{whole}', 0), "
        f"(g, t) -> concat(g, IF(t IS NULL, '', concat('{_A}', {kind}, '{_Z}')))), '')",
    )
    text = _replaced(text, rf"(?i)(?<![\w.{_A}{_CAST}])(?:true|false)(?![\w.])", f"{_A}boolean{_Z}")
    text = _replaced(text, rf"(?i)(?<![\w.{_A}{_CAST}])null(?![\w.])", f"{_A}unknown{_Z}")
    text = _replaced(text, rf"(?i)(?<![\w.{_A}{_CAST}])current_date(?![\w.])", f"{_A}date{_Z}")
    text = _replaced(text, rf"(?i)(?<![\w.{_A}{_CAST}])current_timestamp(?![\w.])", f"{_A}timestamptz{_Z}")
    text = _replaced(text, r"\(\s*\*\s*\)", f"({_A}any{_Z})")
    name = rf"(?i)(?<![\w.{_A}{_CAST}{_BLANK}])(?!(?:{_WORDS})\b)[A-Za-z_][\w.$]*+(?!\s*\()(?:{_A}\?{_Z})?"
    return _replaced(text, name, f"{_A}?{_Z}")


def _type_of(atom: str) -> str:
    """The full name of the type in an atom."""
    inner = f"translate(regexp_extract({atom}, '{_A}([^{_Z}]*){_Z}', 1), '{_BLANK}', ' ')"
    return let(inner, "w", f"IF(endswith(w, '_array'), concat({type_name("regexp_replace(w, '(_array)+$', '')")}, '[]'), {type_name('w')})")


def _promoted(types: str, power: str = "false") -> str:
    """The type of arithmetic between operands."""
    rank = f"array_max(transform(ks, k -> array_position({_NUMERIC}, k)))"
    return let(
        f"filter({types}, k -> k <> 'unknown')",
        "ks",
        f"""
CASE WHEN size(ks) = 0 THEN '?'
     WHEN forall(ks, k -> array_contains({_NUMERIC}, k)) THEN CASE
       WHEN {rank} = 5 AND exists(ks, k -> k <> 'real') THEN 'double precision'
       WHEN {power} AND {rank} <> 4 THEN 'double precision'
       ELSE element_at({_NUMERIC}, int({rank})) END
     WHEN forall(ks, k -> k = 'interval' OR array_contains({_NUMERIC}, k)) THEN 'interval'
     WHEN exists(ks, k -> k = 'interval') AND forall(ks, k -> k = 'interval' OR k IN {_MOMENTS}) THEN CASE
       WHEN array_contains(ks, 'timestamp with time zone') THEN 'timestamp with time zone' ELSE 'timestamp without time zone' END
     WHEN forall(ks, k -> k = 'date') THEN IF(size(ks) > 1, 'integer', 'date')
     WHEN forall(ks, k -> k IN {_MOMENTS}) THEN IF(size(ks) > 1, 'interval', get(ks, 0))
     WHEN array_contains(ks, 'date') AND forall(ks, k -> k IN ('date', 'integer', 'smallint')) THEN 'date'
     WHEN size(array_distinct(ks)) = 1 THEN get(ks, 0)
     ELSE '?' END""",
    )


def _operators(y: str) -> str:
    """The type of atoms with operators between them, the loosest operator first."""
    atoms = f"transform(regexp_extract_all(y, '{_ATOM}', 0), m -> {_type_of('m')})"
    rest = f"regexp_replace(y, '{_ATOM}', '')"
    tests = r"(?i)\b(?:and|or|not|is|isnull|notnull|in|like|ilike|between|similar)\b|&&|(?<![-<>#@|])(?:<>|!=|<=|>=|=|<|>|~)(?![->#])|@>|<@"
    return let(
        y,
        "y",
        let(
            atoms,
            "ts",
            f"""
CASE WHEN contains(y, '{_A}?{_Z}') THEN '?'
     WHEN regexp_like({rest}, r'{tests}') THEN 'boolean'
     WHEN contains(y, '<->') OR contains(y, '<#>') THEN 'double precision'
     WHEN contains(y, '||') THEN coalesce(get(filter(ts, k -> endswith(k, '[]') OR k IN ('jsonb', 'bytea', 'tsvector')), 0), 'text')
     WHEN contains(y, '->>') OR contains(y, '#>>') THEN 'text'
     WHEN contains(y, '->') OR contains(y, '#>') THEN coalesce(get(ts, 0), '?')
     WHEN regexp_like({rest}, r'\\A[-+*/%^\\s]+\\z') THEN {_promoted('ts', "contains(y, '^')")}
     ELSE '?' END""",
        ),
    )


def _known(types: str) -> str:
    """The type of alternatives: numbers promoted, else the first that is known."""
    return let(
        types,
        "all",
        f"IF(exists(all, k -> k = '?'), '?', IF(forall(all, k -> array_contains({_NUMERIC}, k) OR k = 'unknown') AND exists(all, k -> k <> 'unknown'), "
        f"{_promoted('all')}, coalesce(get(filter(all, k -> k <> 'unknown'), 0), 'text')))",
    )


def _flat(x: str) -> str:
    """The type of a text without groups."""
    cast = rf"{_ATOM}(?:\s*{_CAST}[^{_END}]*{_END})*\s*{_CAST}([^{_END}]*){_END}"
    part = r"(?i)\b(?:then|else)\b(.*?)(?=\b(?:when|else|end)\b)"
    plain = lambda v: f"IF(regexp_like({v}, r'\\A{_ATOM}\\z'), {_type_of(v)}, {_operators(v)})"
    branches = f"transform(regexp_extract_all(z, r'{part}', 1), c -> {let(stripped('c'), 'v', plain('v'))})"
    return let(
        stripped(_replaced(x, cast, f"{_A}$1{_Z}")),
        "z",
        f"IF(regexp_like(z, r'(?is)\\Acase\\b.*\\bend\\z'), {_known(branches)}, {plain('z')})",
    )


def _call(functions: str) -> str:
    """The type of a call ``f`` with arguments of types ``ts``: of the overloads that take as many, the one that fits most of them."""
    fits = "size(filter(zip_with(ts, c.types, (x, y) -> x <=> y), ok -> ok))"
    rated = f"transform(filter(cs, c -> c.types IS NULL OR size(c.types) = size(ts)), c -> named_struct('fits', IF(c.types IS NULL, 0, {fits}), 'returned', c.returned))"
    best = let("array_max(transform(rs, r -> r.fits))", "top", "array_min(transform(filter(rs, r -> r.fits = top), r -> r.returned))")
    return let(f"try_element_at({functions}, f)", "cs", let(rated, "rs", f"coalesce({best}, '?')"))


def _group(functions: str) -> str:
    """What stands for one innermost group ``m``."""
    listed = "regexp_replace(m, r'(?s)\\A[^(\\[]*[(\\[]|[)\\]]\\z', '')"
    items = f"IF({stripped('inner')} = '', CAST(array() AS ARRAY<STRING>), split(inner, ','))"
    atom = _atom("k")
    kind = f"""
CASE WHEN f = '' THEN CASE WHEN size(ts) = 1 AND NOT contains(m, '[') THEN get(ts, 0) WHEN exists(ts, k -> k = '?') OR contains(m, '[') THEN '?' ELSE 'record' END
     WHEN contains(m, '[') THEN IF(f = 'array' AND NOT exists(ts, k -> k = '?'), concat({_known('ts')}, '_array'), '?')
     WHEN f = 'cast' THEN coalesce(get(ts, 0), '?')
     WHEN f IN ('coalesce', 'greatest', 'least', 'nullif') THEN {_known('ts')}
     WHEN f = 'exists' THEN 'boolean'
     ELSE {_call(functions)} END"""
    shown = f"""
CASE WHEN regexp_like(f, '^(?:{_BEFORE_GROUP})$') THEN concat(f, ' ', {let("coalesce(get(ts, 0), '?')", 'k', atom)})
     WHEN f IN ('in', 'any', 'all', 'some') THEN concat(f, ' {_A}unknown{_Z}')
     ELSE {let(kind, 'k', atom)} END"""
    return let(
        f"lower(regexp_extract(m, r'(?s)\\A{_GROUP}\\z', 1))",
        "f",
        let(listed, "inner", let(f"transform({items}, x -> {_flat('x')})", "ts", shown)),
    )


def expression_type(a: str, functions: str) -> str:
    """SQL for the type of the expression text ``a``; null where it can't be told.

    ``functions`` is a map from a lower-case name to array<struct<types, returned>> (``types`` null: any arguments). A column, an
    unknown function or a subquery has no type, and neither has an operator next to one; a call with such arguments has the
    type its name gives, and a cast the type it casts to. Casts and literals alone are read at once.
    """
    reduced = f"array_join(zip_with(split(t, r'{_GROUP}', -1), regexp_extract_all(t, r'{_GROUP}', 0), (g, m) -> concat(g, IF(m IS NULL, '', {_group(functions)}))), '')"
    depth = r"sequence(0, size(split(u, r'[(\[]')))"
    whole = let(_atoms(a), "u", let(f"aggregate({depth}, u, (t, _) -> IF(regexp_like(t, r'[(\\[]'), {reduced}, t))", "flat", f"nullif({_flat('flat')}, '?')"))
    # A cast binds tighter than an operator, so only one behind a plain operand types the whole.
    plain = rf"(?is)\A(?:cast\s*\(.*\)|[\w.]+(?:\s*::.*)?|'(?:[^']|'')*'(?:\s*::.*)?|[+-]?[\d.]+(?:e[+-]?\d+)?)\z"
    simple = f"regexp_like({a}, r\"{plain}\") AND NOT regexp_like({a}, r'[-+*/%^|<>=~&](?=.*::)|::.*[-+*/%^|<>=~&]')"
    return f"CASE WHEN {simple} AND {literal_type(a)} IS NOT NULL THEN {literal_type(a)} WHEN regexp_like({a}, r'(?i)\\bselect\\b') THEN NULL ELSE {whole} END"
