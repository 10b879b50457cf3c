"""Reading table, column and call references out of SQL text, as column expressions.

Nothing here is a grammar. Texts are cut at parentheses into pieces, each piece
gets its nesting depth, and the few shapes the scores need are picked from the
pieces with regular expressions. That works for any nesting depth.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITESPACE, norm_ident
from .text import let as named

# Words never read as a column name.
RESERVED = [
    "select", "as", "distinct", "case", "when", "then", "else", "end", "null", "true", "false",
    "limit", "offset", "from", "where", "group", "by", "order", "having", "asc", "desc", "on",
    "join", "left", "right", "inner", "outer", "full", "cross", "union", "all",
]

# Private-use characters that stand for "(", ")" and "," inside quoted text, and
# for a comma between arguments.
_HIDDEN = "\ue000\ue001\ue002"
_PLAIN = "(),"
_ARG_BREAK = "\ue003"

_NAME = r"[A-Za-z_]\w*"
CALL_LEAD = rf"\b({_NAME}(?:\s*\.\s*{_NAME})*)\s*\z"
TABLE_LEAD = rf"#[ \t]*({_NAME})\s*\z"


# --- SQL text of the expressions ---------------------------------------------------------
# Long expressions are written as SQL text; ``let`` works a value out once and names it.


def let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def stripped(c: str) -> str:
    return f"btrim({c}, '{WHITESPACE}')"


# Comments, quoted texts, quoted names and dollar-quoted texts, whichever starts first.
# \x22, \x24 and \x27 are the double quote, the dollar sign and the quote.
_TOKEN = (
    r"(?s)/\*.*?\*/|--[^\n\r]*+|\x27(?:[^\x27]|\x27\x27)*+\x27|\x22(?:[^\x22]|\x22\x22)*+\x22|(\x24\w*\x24).*?\1"
)
_TOKEN_SIGN = r"[\x22\x24\x27]|--|/\*"


def retold(c: str, told: str) -> str:
    """The text with a comment as a blank and each other token ``t`` as ``told`` has it.

    One pass from left to right finds the tokens, so a quote in a comment, or two dashes
    in a quoted text, start nothing.
    """
    whole = let(
        f"regexp_extract_all(c, r'{_TOKEN}', 0)",
        "toks",
        f"array_join(zip_with(split(c, r'{_TOKEN}', -1), toks, (g, t) -> concat(g, CASE WHEN t IS NULL THEN '' "
        f"WHEN startswith(t, '--') OR startswith(t, '/*') THEN ' ' ELSE {told} END)), '')",
    )
    # A text without any sign that a token starts with is left as it is.
    return let(c, "c", f"CASE WHEN regexp_like(c, r'{_TOKEN_SIGN}') THEN {whole} ELSE c END")


def _sanitized(c: str, literal: str = " ") -> str:
    return retold(c, f"CASE WHEN startswith(t, '\"') THEN t ELSE '{literal}' END")


def _masked(c: str) -> str:
    return retold(c, f"translate(t, '{_PLAIN}', '{_HIDDEN}')")


def unmasked(c: str) -> str:
    return f"translate({c}, '{_HIDDEN}', '{_PLAIN}')"


_BLOCK = 256


def running_sums(signs: str) -> str:
    """Prefix sums of an int array: within blocks, then the sums in front of each block.

    An array grows by copying, so one fold over n values would cost n * n; blocks keep it
    near n for any text that fits a row.
    """
    fold = "aggregate({0}, CAST(array() AS ARRAY<INT>), (acc, x) -> concat(acc, array(coalesce(try_element_at(acc, -1), 0) + x)))"
    # A slice copies the whole array, so a block is read by place.
    block = f"transform(sequence(b, greatest(least(b + {_BLOCK}, size({signs})) - 1, b)), i -> get({signs}, i))"
    return let(
        f"transform(sequence(0, greatest(size({signs}) - 1, 0), {_BLOCK}), b -> {fold.format(block)})",
        "blocks",
        let(
            fold.format("transform(blocks, b -> coalesce(try_element_at(b, -1), 0))"),
            "sums",
            "flatten(transform(blocks, (b, i) -> transform(b, d -> d + coalesce(get(sums, i - 1), 0))))",
        ),
    )


def _pieces(c: str) -> str:
    sign = "CASE WHEN startswith(p, '(') THEN 1 WHEN startswith(p, ')') THEN -1 ELSE 0 END"
    return let(
        f"split({c}, r'(?=[()])')",
        "parts",
        let(
            f"transform(parts, p -> {sign})",
            "signs",
            f"zip_with(parts, {running_sums('signs')}, (p, d) -> named_struct('text', p, 'depth', d))",
        ),
    )


def closed_groups(p: str, lead: str, named: str | None = None) -> str:
    """Closed parenthesised groups of the pieces ``p`` whose lead-in matches ``lead``.

    array<struct<start, stop, name, items>>: the name is group 1 of the lead-in, the items are
    the comma list at the group's own depth, trimmed. ``named`` is an SQL text; only groups
    whose name equals it, apart from case and blanks, are then worked out.
    """
    before = f"get({p}, e.x.at - 1).text"
    fits = f"regexp_like({before}, r'{lead}')"
    if named:
        fits = rf"lower(regexp_replace(regexp_extract({before}, r'{lead}', 1), r'\s+', '')) = lower({named})"
    # A slice copies the whole array, so a group's pieces are read by place.
    items = (
        f"filter(transform(split(substr(array_join(transform(transform(sequence(g.start, g.stop - 1), k -> get({p}, k)), "
        f"x -> CASE WHEN x.depth = get({p}, g.start).depth THEN translate(x.text, ',', '{_ARG_BREAK}') "
        f"ELSE x.text END), ''), 2), '{_ARG_BREAK}'), a -> {stripped('a')}), a -> a <> '')"
    )
    # Parentheses of one depth open and close by turns, so in the order of depth and place a group is
    # an opening piece and the closing one behind it: one sort instead of a search per group.
    events = (
        f"sort_array(transform(filter(sequence(0, size({p}) - 1), k -> k > 0), k -> named_struct("
        f"'depth', get({p}, k).depth + IF(startswith(get({p}, k).text, ')'), 1, 0), 'at', k, 'opens', startswith(get({p}, k).text, '('))))"
    )
    pairs = (
        "sort_array(transform(filter(zip_with(ev, slice(ev, 2, size(ev)), (x, y) -> named_struct('x', x, 'y', y)), "
        f"e -> e.x.opens AND NOT e.y.opens AND e.x.depth = e.y.depth AND {fits}), e -> named_struct('start', e.x.at, 'stop', e.y.at)))"
    )
    return let(
        events,
        "ev",
        f"transform({pairs}, g -> named_struct('start', g.start, 'stop', g.stop, "
        f"'name', regexp_extract(get({p}, g.start - 1).text, r'{lead}', 1), 'items', {items}))",
    )


def list_items(c: str) -> str:
    """The comma list of a text without parentheses as ``closed_groups`` has it."""
    return f"filter(transform(split(translate({c}, ',', '{_ARG_BREAK}'), '{_ARG_BREAK}'), a -> {stripped('a')}), a -> a <> '')"


def outermost(gs: str) -> str:
    """The groups that lie in no other one."""
    return f"filter({gs}, g -> NOT exists({gs}, o -> o.start < g.start AND o.stop > g.start))"


def unquoted(arg: str) -> str:
    """Content of a quoted argument, a trailing ``::type`` dropped; null for others."""
    return let(
        rf"regexp_replace({stripped(arg)}, r'::\s*\w+\s*\z', '')",
        "u",
        "CASE WHEN startswith(u, \"'\") AND endswith(u, \"'\") AND length(u) >= 2 "
        "THEN replace(substr(u, 2, length(u) - 2), \"''\", \"'\") END",
    )


# What counts as a table, an owner and column, or a bare name.
_FROM = rf'(?i)\b(?:from|join)\b\s+("?[A-Za-z_][\w.]*"?)(?:\s+(?:as\s+)?({_NAME}))?'
_QUALIFIED = r'\b("?[A-Za-z_][\w$]*"?)\s*\.\s*("?[A-Za-z_][\w$]*"?)\b'
_BARE = rf"(?U)(?<!\.)\b({_NAME})\b(?!\s*\()"


def from_items(c: str) -> str:
    # One pass finds the items; their parts are read from what it found.
    return (
        f"transform(regexp_extract_all({c}, r'{_FROM}', 0), m -> "
        + let(
            f"btrim(regexp_extract(m, r'{_FROM}', 1), '\"`')",
            "r",
            f"named_struct('raw', r, 'table', substring_index(r, '.', -1), 'alias', nullif(regexp_extract(m, r'{_FROM}', 2), ''))",
        )
        + ")"
    )


def owner_pairs(c: str, clean: bool = False) -> str:
    """Of a text, or of one without comments and quoted texts if ``clean``."""
    # A match has one dot, and neither name has white space; around the dot is what \s stands for.
    part = lambda k: f"btrim(substring_index(m, '.', {k}), ' \t\n\x0b\f\r\"')"
    pairs = f"transform(regexp_extract_all(clean, r'{_QUALIFIED}', 0), m -> named_struct('owner', {part(1)}, 'column', {part(-1)}))"
    return let(c if clean else _sanitized(c), "clean", f"CASE WHEN NOT contains(clean, '.') THEN array() ELSE {pairs} END")


def bare_names(c: str, clean: bool = False, among: str | None = None) -> str:
    """``among`` names an array; only its values are kept then."""
    text = c if clean else _sanitized(c)
    words = ", ".join(f"'{w}'" for w in RESERVED)
    found = f"regexp_extract_all({text}, r'{_BARE}', 1)"
    found = f"array_intersect({found}, {among})" if among else f"array_distinct({found})"
    return f"filter({found}, n -> lower(n) NOT IN ({words}))"


# --- column functions; each takes the name of a column ------------------------------------


def sanitize_sql(name: str) -> Column:
    """Comments and quoted texts replaced by a blank."""
    return F.expr(_sanitized(name))


def paren_pieces(name: str, masked: bool = True) -> Column:
    """array<struct<text, depth>>: the text cut before every parenthesis.

    A piece that opens has the depth of its inside, one that closes the depth around the
    closed pair. ``masked`` keeps quoted parentheses and commas out of it.
    """
    return F.expr(_pieces(_masked(name) if masked else name))


# One table of a schema text, with up to two levels of parentheses inside its own.
_SHALLOW = r"\((?:[^()]++|\([^()]*+\))*+\)"
_TABLE_TEXT = rf"#[ \t]*({_NAME})\s*\(((?:[^()]++|{_SHALLOW})*+)\)"


def _schema_readers(name: str) -> tuple[str, str, str]:
    """When the one-expression reader may be used, that reader and the one by pieces, as SQL."""
    column = rf"regexp_extract(i, r'\A[{WHITESPACE}]*+[\"`]?({_NAME})', 1)"
    firsts = lambda tables: let(
        tables,
        "ts",
        let(
            "transform(ts, t -> t.table)",
            "names",
            "filter(ts, (t, i) -> array_position(names, t.table) = i + 1)",
        ),
    )
    shallow = (
        # One search finds the tables; what is behind the first parenthesis of one is its list.
        f"transform(regexp_extract_all({name}, r'{_TABLE_TEXT}', 0), m -> named_struct('table', regexp_extract(m, r'#[ \t]*({_NAME})', 1), "
        f"'columns', filter(transform(split(regexp_replace(substr(m, instr(m, '(') + 1, length(m) - instr(m, '(') - 1), r'{_SHALLOW}', ''), ','), "
        f"i -> {column}), n -> n <> '')))"
    )
    deep = let(
        _pieces(name),
        "ps",
        let(
            closed_groups("ps", TABLE_LEAD),
            "gs",
            f"transform({outermost('gs')}, g -> named_struct('table', g.name, 'columns', "
            f"filter(transform(g.items, i -> {column}), n -> n <> '')))",
        ),
    )
    rest = rf"regexp_replace(regexp_replace({name}, r'{_SHALLOW}', ''), r'\([^()]*\)', '')"
    return f"NOT {let(rest, 'rest', "(contains(rest, '(') OR contains(rest, ')'))")}", firsts(shallow), firsts(deep)


def schema_tables(name: str) -> Column:
    """array<struct<table, columns>> of ``# name (col type, ...)`` text.

    A group inside another closed table is part of that table. The first definition of a
    name wins. Texts whose parentheses all close and nest no deeper than column types, which is nearly
    all, are read by one regular expression; the others by their pieces, at any depth. Both give
    the same tables wherever the first applies.
    """
    plain, shallow, deep = _schema_readers(name)
    return F.expr(f"CASE WHEN {plain} THEN {shallow} ELSE {deep} END")


def from_tables(name: str) -> Column:
    """array<struct<raw, table, alias>> of the FROM and JOIN items in text order.

    ``table`` is the last dotted part; only the first item of a comma list is seen.
    """
    return F.expr(from_items(name))


def qualified_columns(name: str) -> Column:
    """array<struct<owner, column>> of the ``owner.column`` pairs."""
    return F.expr(owner_pairs(name))


def bare_columns(name: str) -> Column:
    """Distinct names, in first-seen order, that stand neither behind a dot nor before "("."""
    return F.expr(bare_names(name))


def order_spec(name: str) -> Column:
    """array<struct<column, ascending>> of a plain ORDER BY list."""
    item = r'\A([\w.\"`]+)(?:\s+(asc|desc))?\z'
    body = (
        rf"regexp_extract(lower(regexp_replace({stripped(f"coalesce({name}, '')")}, r';+\z', '')), "
        r"r'(?s)\border\s+by\s+(.*?)(?:\s+limit\b|;|\z)', 1)"
    )
    return F.expr(
        f"transform(filter(transform(split({body}, ','), p -> {stripped('p')}), p -> regexp_like(p, r'{item}')), "
        f"p -> named_struct('column', btrim(regexp_extract(p, r'{item}', 1), '\"`'), "
        f"'ascending', regexp_extract(p, r'{item}', 2) <> 'desc'))"
    )


def structure_valid(name: str, pieces: str) -> Column:
    """Whether a text has the shape of a statement: a statement keyword in front, closed quotes
    and comments, balanced parentheses outside them and no clause without content.

    ``pieces`` names the pieces of the masked text.
    """
    keywords = "select|with|update|delete|insert|create|drop|alter|values|explain"
    clean = stripped(rf"regexp_replace({_sanitized(name, "0")}, r'[\s;]+\z', '')")
    test = (
        # What is left of a quote or comment sign was never closed.
        r"NOT regexp_like(regexp_replace(clean, r'\x22[^\x22]*+\x22', 'q'), r'[\x22\x27]|/\*|\x24\w*\x24') "
        "AND element_at(ds, -1) = 0 AND array_min(ds) >= 0 "
        rf"AND regexp_like(clean, r'(?is)\A\(*\s*(?:{keywords})\b\s*\S.*') "
        r"AND NOT regexp_like(clean, r'(?is)\b(?:from|where|by|on|and|or|join)\s+(?:from|where|group|order|having|limit|join)\b') "
        r"AND NOT regexp_like(clean, r'(?is)(?:,|\b(?:from|where|and|or|by|select|join|on)|[=<>+*/-])\z')"
    )
    depths = f"transform({pieces}, p -> p.depth)"
    return F.expr(f"coalesce({let(depths, 'ds', let(clean, 'clean', test))}, false)")


# Short names of types and the names the database reports.
TYPE_ALIASES = {
    "int": "integer", "int4": "integer", "int2": "smallint", "int8": "bigint",
    "float": "double precision", "float8": "double precision", "float4": "real",
    "decimal": "numeric", "bool": "boolean", "varchar": "character varying",
    "char": "character", "timestamp": "timestamp without time zone",
    "timestamptz": "timestamp with time zone", "time": "time without time zone",
}

def type_name(t: str) -> str:
    """A written type as the database names it, without length and in lower case."""
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in TYPE_ALIASES.items())
    plain = rf"regexp_replace({stripped(rf"regexp_replace(lower({t}), r'\s*\([^()]*\)', '')")}, r'\s+', ' ')"
    return let(plain, "w", f"coalesce(try_element_at(map({pairs}), w), w)")


def literal_type(a: str) -> str:
    """SQL for the type of an argument read from its text; null when it is no cast or literal."""
    written = r"([A-Za-z_][\w ]*(?:\([^()]*\))?)"
    cast_call = rf"(?is)\Acast\s*\(.*\bas\s+{written}\s*\)\z"
    cast_to = rf"(?is)\A.*::\s*{written}\s*\z"
    size = f"try_cast({a} AS DECIMAL(38, 0))"
    return f"""
CASE WHEN regexp_like({a}, r'{cast_call}') THEN {type_name(f"regexp_extract({a}, r'{cast_call}', 1)")}
     WHEN regexp_like({a}, r'{cast_to}') THEN {type_name(f"regexp_extract({a}, r'{cast_to}', 1)")}
     WHEN regexp_like({a}, r'\\A[+-]?\\d+\\z') THEN CASE WHEN abs({size}) <= 2147483647 THEN 'integer'
       WHEN abs({size}) <= 9223372036854775807 THEN 'bigint' ELSE 'numeric' END
     WHEN regexp_like({a}, r'(?i)\\A[+-]?(\\d+\\.\\d*|\\.\\d+|\\d+)(e[+-]?\\d+)?\\z') THEN 'numeric'
     WHEN lower({a}) IN ('true', 'false') THEN 'boolean'
     WHEN regexp_like({a}, r"(?s)\\A[Ee]?'.*'\\z") OR lower({a}) = 'null' THEN 'unknown' END
"""


def ref_pairs(tables: str) -> Column:
    """Distinct (table, column) pairs of picked tables, names normalised.

    Tables without columns leave no pair.
    """
    pairs = F.flatten(
        F.transform(
            F.coalesce(F.col(tables), F.array().cast("array<struct<table:string,columns:array<string>>>")),
            lambda t: named(
                norm_ident(t["table"]),
                lambda table: F.transform(
                    F.coalesce(t["columns"], F.array().cast("array<string>")),
                    lambda c: F.struct(table.alias("table"), norm_ident(c).alias("column")),
                ),
            ),
        )
    )
    return F.array_distinct(F.filter(pairs, lambda p: p["table"] != ""))


def overlap(a: Column, b: Column) -> Column:
    """How many values two arrays share."""
    return F.size(F.array_intersect(a, b))


def union_refs(a: Column, b: Column) -> Column:
    """Values of both arrays, first seen kept, in order."""
    return F.array_distinct(F.concat(a, b))
