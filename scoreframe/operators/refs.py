"""Tables and columns a query refers to, and how they agree with the gold references.

Everything happens inside the row: the catalog of a query is an array next to its SQL,
so finding references needs no shuffle. The catalog is parsed once per item and
joined, not parsed per prediction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext as S
from .order import last_per_key

# Geometry-management functions with the position of their table argument and the
# positions their column may have (behind it, or one later when a schema comes first).
MANAGEMENT = {
    "addgeometrycolumn": (0, (1, 2)),
    "dropgeometrycolumn": (0, (1, 2)),
    "dropgeometrytable": (0, ()),
    "find_srid": (1, (2,)),
    "populate_geometry_columns": (0, ()),
    "recovergeometrycolumn": (1, (2,)),
    "st_estimatedextent": (0, (1,)),
    "updategeometrysrid": (0, (1, 2)),
}
TABLE_FIRST = [f for f, (table, _) in MANAGEMENT.items() if table == 0]
TABLE_SECOND = [f for f, (table, _) in MANAGEMENT.items() if table == 1]
COLUMNS_SECOND = [f for f, (_, columns) in MANAGEMENT.items() if 1 in columns]
COLUMNS_THIRD = [f for f, (_, columns) in MANAGEMENT.items() if 2 in columns]


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def parse_schema(df: DataFrame, text: str = "schema", name: str = "catalog") -> DataFrame:
    """Add the catalog, array<struct<table, columns>>, of a schema text."""
    return df.withColumn(name, S.schema_tables(f"coalesce({text}, '')"))


def catalog_rows(df: DataFrame, *keys: str, name: str = "catalog") -> DataFrame:
    """Catalog in long form: (keys, table, col_idx, column).

    ``explode_outer`` keeps Spark from working the catalog out once more to drop empty ones.
    """
    tables = df.select(*keys, F.explode_outer(name).alias("_t")).where("_t IS NOT NULL")
    return tables.select(
        *keys, F.col("_t.table").alias("table"), F.posexplode("_t.columns").alias("col_idx", "column")
    )


def _has(table: str, column: str) -> str:
    return f"exists(cat, t -> t.table = {table} AND array_contains(t.columns, {column}))"


def _known(table: str) -> str:
    return f"exists(cat, t -> t.table = {table})"


def _call_readers(c: str) -> tuple[str, str, str]:
    """When the reader by one expression may be used, that reader and the one by pieces, as SQL.

    Both read array<struct<name, items>> of a masked text. Calls without parentheses between theirs, which are
    nearly all, close at once and lie in no other one.
    """
    names = "|".join(sorted({*TABLE_FIRST, *TABLE_SECOND}))
    opened, closed = rf"(?i)\b({names})\s*\(", rf"(?i)\b({names})\s*\([^()]*+\)"
    plain = f"size(regexp_extract_all({c}, r'{opened}', 0)) = size(regexp_extract_all({c}, r'{closed}', 0))"
    flat = (
        f"transform(regexp_extract_all({c}, r'{closed}', 0), m -> named_struct('name', regexp_extract(m, r'{closed}', 1), "
        f"'items', {S.list_items(r"substr(m, instr(m, '(') + 1, length(m) - instr(m, '(') - 1)")}))"
    )
    groups = S.closed_groups("ps", rf"(?i)\b({names})\s*\z")
    outer = f"transform({S.outermost('gs')}, g -> named_struct('name', g.name, 'items', g.items))"
    return plain, flat, S.let(S._pieces(c), "ps", S.let(groups, "gs", outer))


def _management_calls(sql: str) -> str:
    """Closed calls of management functions, none inside another: (fn, args), args unquoted."""
    plain, flat, deep = _call_readers("masked")
    told = (
        f"transform(CASE WHEN {plain} THEN {flat} ELSE {deep} END, g -> named_struct('fn', lower(g.name), "
        f"'args', transform(g.items, i -> nullif({S.unquoted(S.unmasked('i'))}, ''))))"
    )
    calls = S.let(S._masked(sql), "masked", told)
    # Few texts name such a function; the others are not taken apart.
    named = S.let(f"lower({sql})", "low", " OR ".join(f"contains(low, '{n}')" for n in sorted(MANAGEMENT)))
    return f"CASE WHEN {named} THEN {calls} ELSE array() END"


def _management_refs(sql: str) -> str:
    """array<struct<table, columns>> of known tables named by management calls."""
    named = (
        f"transform({_management_calls(sql)}, c -> named_struct("
        f"'table', CASE WHEN c.fn IN {_in(TABLE_FIRST)} THEN get(c.args, 0) "
        "WHEN get(c.args, 0) IS NOT NULL THEN get(c.args, 1) END, "
        f"'columns', array_compact(array(CASE WHEN c.fn IN {_in(COLUMNS_SECOND)} THEN get(c.args, 1) END, "
        f"CASE WHEN c.fn IN {_in(COLUMNS_THIRD)} THEN get(c.args, 2) END))))"
    )
    columns = (
        "filter(array_distinct(flatten(transform(filter(ns, n -> n.table = x), n -> n.columns))), "
        f"c -> {_has('x', 'c')})"
    )
    return S.let(
        f"filter({named}, n -> {_known('n.table')})",
        "ns",
        f"transform(array_distinct(transform(ns, n -> n.table)), x -> named_struct('table', x, 'columns', {columns}))",
    )


def management_refs(
    df: DataFrame, sql: str = "pred_sql", catalog: str = "catalog", name: str = "mgmt_refs"
) -> DataFrame:
    """Add array<struct<table, columns>> named by the string arguments of management calls."""
    return df.withColumn(name, F.expr(S.let(catalog, "cat", _management_refs(sql))))


def management_tables(
    df: DataFrame, sql: str = "pred_sql", catalog: str = "catalog", name: str = "mgmt_tables"
) -> DataFrame:
    """Add the known tables named by management calls: the second text when there are two."""
    tables = (
        f"array_distinct(filter(transform({_management_calls(sql)}, c -> CASE WHEN get(c.args, 0) IS NOT NULL "
        f"THEN coalesce(get(c.args, 1), get(c.args, 0)) END), x -> {_known('x')}))"
    )
    return df.withColumn(name, F.expr(S.let(catalog, "cat", tables)))


def _hits(sql: str) -> str:
    """(table, column) pairs a text uses; needs cat, the FROM items fs and the tables ts.

    ``owner.column`` goes through the alias list. A bare name counts when exactly one
    table of the query has it and it is no alias. Only names that are columns of the query's
    tables can count, so the text is read only if there are such tables, and other names are dropped first.
    The columns of those tables are one list of pairs, so that a pair is looked up by comparing it.
    """
    is_name = "f.table <=> {0} OR f.raw <=> {0} OR f.alias <=> {0}"
    qualified = (
        f"filter(transform(filter({S.owner_pairs('told', clean=True)}, q -> exists(own, o -> o.column = q.column)), q -> named_struct('table', "
        f"try_element_at(filter(fs, f -> {is_name.format('q.owner')}), -1).table, 'column', q.column)), "
        "h -> exists(own, o -> o.column = h.column AND o.table = h.table))"
    )
    # The catalog may list a table twice; it is one owner.
    owned = S.let(
        "array_distinct(transform(filter(own, o -> o.column = b), o -> o.table))",
        "owners",
        "named_struct('table', CASE WHEN size(owners) = 1 THEN get(owners, 0) END, 'column', b)",
    )
    used = f"filter({S.bare_names('told', clean=True, among='names')}, b -> NOT exists(fs, f -> {is_name.format('b')}))"
    bare = f"filter(transform({used}, b -> {owned}), h -> h.table IS NOT NULL)"
    # Both read the text without comments and quoted texts.
    both = S.let(S._sanitized(sql), "told", f"array_distinct(concat({qualified}, {bare}))")
    some = f"CASE WHEN size(own) > 0 THEN {S.let('transform(own, o -> o.column)', 'names', both)} ELSE array() END"
    # ``array_contains`` asks for the type of its value each time, which a field of a struct has to look up.
    known = "filter(cat, t -> exists(ts, x -> x = t.table))"
    own = (
        f"flatten(transform({known}, t -> transform(coalesce(t.columns, CAST(array() AS ARRAY<STRING>)), "
        "c -> named_struct('table', t.table, 'column', c))))"
    )
    return S.let(own, "own", some)


def resolve_columns(
    df: DataFrame, sql: str = "pred_sql", catalog: str = "catalog", name: str = "hits"
) -> DataFrame:
    """Add array<struct<table, column>>: the columns of its FROM tables a query uses."""
    sql = f"coalesce({sql}, '')"
    tables = "array_distinct(transform(fs, f -> f.table))"
    body = S.let(S.from_items(sql), "fs", S.let(tables, "ts", _hits(sql)))
    return df.withColumn(name, F.expr(S.let(catalog, "cat", body)))


def pick_refs(
    df: DataFrame, sql: str = "pred_sql", catalog: str = "catalog", name: str = "tables"
) -> DataFrame:
    """Add the picked references: the query's tables in order with the columns it uses.

    A known table is listed even without columns, an unknown one is not.
    """
    sql = f"coalesce({sql}, '')"
    columns = (
        "array_distinct(concat(transform(filter(hs, h -> h.table = x), h -> h.column), "
        "coalesce(get(filter(ms, m -> m.table = x), 0).columns, CAST(array() AS ARRAY<STRING>))))"
    )
    picked = f"filter(transform(ts, x -> named_struct('table', x, 'columns', {columns})), p -> size(p.columns) > 0 OR {_known('p.table')})"
    tables = "array_distinct(concat(transform(fs, f -> f.table), transform(ms, m -> m.table)))"
    body = S.let(tables, "ts", S.let(_hits(sql), "hs", picked))
    for value, label in ((_management_refs(sql), "ms"), (S.from_items(sql), "fs"), (catalog, "cat")):
        body = S.let(value, label, body)
    return df.withColumn(name, F.expr(body))


def ref_map(df: DataFrame, *keys: str, tables: str = "tables") -> DataFrame:
    """Long lookup form of picked tables: (keys, table, columns sorted)."""
    pairs = df.select(*keys, S.ref_pairs(tables).alias("_pairs"))
    names = F.array_distinct(F.transform("_pairs", lambda p: p["table"]))
    return pairs.select(*keys, "_pairs", F.explode(names).alias("table")).select(
        *keys,
        "table",
        F.sort_array(
            F.transform(
                F.filter("_pairs", lambda p: p["table"] == F.col("table")), lambda p: p["column"]
            )
        ).alias("columns"),
    )


def hit_rates(
    pred: DataFrame,
    gold: DataFrame,
    by: tuple[str, ...] = ("model",),
    key: str = "id",
    ord_col: str | None = None,
    strict: bool = False,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """Micro-averaged recall of gold tables and columns over the matched ids.

    Ids without predicted references are skipped; ``strict`` counts them as misses. With
    ``ord_col`` the last record of (by, key) counts, of equal ones the least by ``ties``. Gold has
    one record per id.
    """
    if ord_col:
        pred = last_per_key(pred, [*by, key], ord_col, ties)
    tables = lambda pairs: F.array_distinct(F.transform(pairs, lambda p: p["table"]))
    p = pred.select(*by, key, S.ref_pairs("tables").alias("_p"))
    g = gold.select(key, S.ref_pairs("tables").alias("_g"))
    counted = F.lit(True) if strict else F.size("_p") > 0
    joined = p.join(g, key).select(
        *by,
        counted.alias("_ok"),
        F.size(tables(F.col("_g"))).alias("tt"),
        S.overlap(tables(F.col("_g")), tables(F.col("_p"))).alias("th"),
        F.size("_g").alias("ct"),
        S.overlap(F.col("_g"), F.col("_p")).alias("ch"),
    )
    rate = lambda hit, total: F.round(
        F.coalesce(F.try_divide(F.col(hit), F.col(total)), F.lit(1.0)), 4
    )
    total = lambda c: F.coalesce(F.sum(F.when(F.col("_ok"), F.col(c))), F.lit(0)).cast("bigint")
    return (
        joined.groupBy(*by)
        .agg(
            F.count_if("_ok").alias("matched_items"),
            total("th").alias("table_hit_count"),
            total("tt").alias("table_total_count"),
            total("ch").alias("column_hit_count"),
            total("ct").alias("column_total_count"),
        )
        .withColumns(
            {
                "table_hit_rate": rate("table_hit_count", "table_total_count"),
                "column_hit_rate": rate("column_hit_count", "column_total_count"),
            }
        )
    )
