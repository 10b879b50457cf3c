"""Comparison of result tables held as cells.

A cells frame has one row per cell: (keys..., side, row_idx, col_idx, col_name, value) with
side ``pred`` or ``gold``. The expected result of a syntax item is the gold side.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions.text import strip
from ..session import materialize

KEYS = ("query_id",)
PRED, GOLD = "pred", "gold"
# Stands for NULL in hashes and row texts; no database text can hold it.
_NULL = "\x00"


def _side(name: str) -> Column:
    return F.col("side") == name


def _shown(value: Column) -> Column:
    return F.coalesce(F.lower(strip(value)), F.lit(_NULL))


# --- expected results -------------------------------------------------------------------


def expected_rows(result: Column, names: Column, n_rows: Column) -> Column:
    """array<array<string>> of an expected result given as VARIANT.

    Text is one trimmed cell; a list of lists is taken as it is; objects give their
    values by result column name, '' when missing; all else is a blank table of the
    result's shape.
    """
    kind = F.coalesce(F.schema_of_variant(result), F.lit("VOID"))
    by_name = lambda o: F.transform(
        names, lambda n: F.coalesce(F.try_element_at(o, n), F.lit(""))
    )
    blank = F.transform(
        F.sequence(F.lit(1), F.greatest(n_rows, F.lit(1))),
        lambda _: F.transform(names, lambda n: F.lit("")),
    )
    return (
        F.when(
            kind == "STRING",
            F.array(F.array(strip(F.try_variant_get(result, "$", "string")))),
        )
        .when(
            kind.startswith("ARRAY<ARRAY") | (kind == "ARRAY<VOID>"),
            F.try_variant_get(result, "$", "array<array<string>>"),
        )
        .when(
            kind.startswith("ARRAY<OBJECT"),
            F.transform(F.try_variant_get(result, "$", "array<map<string,string>>"), by_name),
        )
        .when(
            kind.startswith("OBJECT"),
            F.array(by_name(F.try_variant_get(result, "$", "map<string,string>"))),
        )
        .otherwise(F.when(n_rows > 0, blank).otherwise(F.array().cast("array<array<string>>")))
    )


def to_cells(
    df: DataFrame, rows: str, names: str | None = None, side: str = GOLD,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Cells of a column of row matrices (array<array<string>>)."""
    cells = df.select(
        *keys,
        *([names] if names else []),
        F.posexplode_outer(rows).alias("row_idx", "_row"),
    ).where("row_idx IS NOT NULL").select("*", F.posexplode("_row").alias("col_idx", "value"))
    name = F.get(F.col(names), F.col("col_idx")) if names else F.lit(None).cast("string")
    return cells.select(
        *keys,
        F.lit(side).alias("side"),
        "row_idx",
        "col_idx",
        name.alias("col_name"),
        "value",
    )


# --- row level ---------------------------------------------------------------------------


def row_counts(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of both results per query."""
    first = F.col("col_idx") == 0
    return cells.groupBy(*keys).agg(
        F.count_if(first & _side(PRED)).alias("pred_rows"),
        F.count_if(first & _side(GOLD)).alias("gold_rows"),
    )


def empty_rule(
    pred_rows: Column, gold_rows: Column, gold_ok: Column | None = None, table_level: bool = True
) -> Column:
    """``unknown`` where nothing can be compared, else null.

    Table level: both results empty or the gold query failed. Syntax level: no
    predicted rows.
    """
    if not table_level:
        return F.when(pred_rows == 0, F.lit("unknown"))
    nothing = (pred_rows == 0) & (gold_rows == 0)
    if gold_ok is not None:
        nothing = nothing | ~gold_ok
    return F.when(nothing, F.lit("unknown"))


def row_count_gate(
    counts: DataFrame, table_level: bool = True, gold_ok: Column | None = None
) -> DataFrame:
    """Decide queries by their row counts: adds ``result_correct`` (null = compare the cells)."""
    pred, gold = F.col("pred_rows"), F.col("gold_rows")
    message = F.format_string("Row count mismatch: pred %d vs gold %d", pred, gold)
    early = empty_rule(pred, gold, gold_ok, table_level)
    return counts.withColumns(
        {
            "result_correct": F.coalesce(early, F.when(pred != gold, F.lit("incorrect"))),
            "execution_error": F.when(early.isNull() & (pred != gold), message).otherwise(
                F.lit("")
            ),
        }
    )


def comparable(cells: DataFrame, gate: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cells of the queries that passed the gate."""
    return cells.join(gate.where("result_correct IS NULL").select(*keys), list(keys), "left_semi")


def column_names(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Columns of each result: (keys, side, col_idx, col_name)."""
    return cells.groupBy(*keys, "side", "col_idx").agg(F.max("col_name").alias("col_name"))


def _rows(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows as arrays of (column, value); one row's cells are few."""
    return cells.groupBy(*keys, "side", "row_idx").agg(
        F.array_sort(F.collect_list(F.struct("col_idx", "value"))).alias("_cells")
    )


def distinct_rows(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Drop repeated rows of a result; the first one stays."""
    firsts = (
        _rows(cells, keys)
        .groupBy(*keys, "side", "_cells")
        .agg(F.min("row_idx").alias("row_idx"))
        .select(*keys, "side", "row_idx")
    )
    return cells.join(firsts, [*keys, "side", "row_idx"], "left_semi")


def normalize_table(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Order-free rows: columns by name, texts trimmed and lower case, and how often each occurs.

    Exact repeats of a row count once, as rows of a result set.
    """
    row = F.transform("_cells", lambda c: F.struct(c["col_name"].alias("c"), _shown(c["value"]).alias("v")))
    rows = (
        cells.groupBy(*keys, "side", "row_idx")
        .agg(F.array_sort(F.collect_list(F.struct("col_name", "value"))).alias("_cells"))
        .select(*keys, "side", "_cells")
        .distinct()
    )
    return (
        rows.withColumn("row", F.to_json(row))
        .groupBy(*keys, "side", "row")
        .agg(F.count("*").alias("times"))
    )


def ordered_rows(cells: DataFrame, specs: DataFrame, keys: Sequence[str] = KEYS, parts: int | None = None) -> DataFrame:
    """(keys, side, row_idx, place): the rows of a result in the order its text asks for.

    ``specs`` has (keys, side, spec), the array of ``order_spec``. Names that are no columns of the
    result are skipped; rows that agree on all others keep their order. Results whose spec names none
    of their columns are left out: ``normalize_table`` is their normal form.

    A row's sort key is one byte string: each value escaped and ended, with all its bits turned over where the column
    falls, then the row's number. A range sort deals the keys of a result, however long, over all tasks; each task numbers
    its stretch, and the rows in front of a stretch come from one count per result and stretch. ``parts`` is the number of
    stretches, by default that of shuffle partitions.
    """
    asked = specs.select(*keys, "side", F.posexplode("spec").alias("_at", "_by"))
    asked = asked.select(*keys, "side", "_at", F.col("_by.column").alias("col_name"), F.col("_by.ascending").alias("_up"))
    found = cells.select(*keys, "side", "row_idx", "col_name", "value").join(asked, [*keys, "side", "col_name"])
    rows = found.groupBy(*keys, "side", "row_idx")
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("_at", F.col("_up").alias("up"), F.col("value").alias("v")))).alias("_by"))
    rows = materialize(rows.select(*keys, "side", "row_idx", _sort_key(F.col("_by")).alias("_key")), "sort-keys")
    order = [*keys, "side", "_key", "row_idx"]
    n = parts or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # Stored, since where the stretches are cut comes from a sample.
    dealt = materialize(dealt.select(*keys, "side", "row_idx", "_key", F.spark_partition_id().alias("_stretch")), "stretches")
    within = F.row_number().over(Window.partitionBy(*keys, "side", "_stretch").orderBy("_key", "row_idx"))
    counts = dealt.groupBy(*keys, "side", "_stretch").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys, "side").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "side", "_stretch", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    same = F.lit(True)
    for c in [*keys, "side", "_stretch"]:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}"))
    placed = dealt.withColumn("_within", within).alias("r").join(counts.alias("c"), same)
    return placed.select(
        *[F.col(f"r.{c}").alias(c) for c in (*keys, "side", "row_idx")], (F.col("c._before") + F.col("r._within")).cast("int").alias("place")
    )


def _sort_key(by: Column) -> Column:
    """Hex digits that compare as the values do, column after column, nulls first where the column rises.

    A value is its bytes in hex, two digits each; digits below 0 end it, so that a value sorts in front of those it starts.
    Turned over digit by digit, the same text sorts the other way round.
    """
    rising = lambda e: F.coalesce(F.concat(F.lit("1"), F.hex(F.encode(e["v"], "UTF-8")), F.lit("!")), F.lit("0!"))
    # "!" ends a rising value below all digits; "~" ends a falling one above them.
    falling = lambda e: F.translate(rising(e), "0123456789ABCDEF!", "FEDCBA9876543210~")
    place = lambda e: F.lpad(e["_at"].cast("string"), 5, "0")
    return F.array_join(F.transform(by, lambda e: F.concat(place(e), F.when(e["up"], rising(e)).otherwise(falling(e)))), "")


def multiset_compare(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, same_rows): whether both results hold the same rows in any order."""
    normal = normalize_table(cells, keys)
    times = lambda s: F.coalesce(F.sum(F.when(_side(s), F.col("times"))), F.lit(0))
    per_row = normal.groupBy(*keys, "row").agg((times(PRED) == times(GOLD)).alias("_same"))
    return per_row.groupBy(*keys).agg(F.bool_and("_same").alias("same_rows"))


# --- by position -------------------------------------------------------------------------


def compare_positional(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each predicted cell next to the expected cell of its place ('' when missing).

    Both sides meet in one aggregation by place, so the table is shuffled once. Adds
    the result of every strategy: as_text, equals, z, value.
    """
    at = lambda s: F.max(F.when(_side(s), F.coalesce("value", F.lit(_NULL))))
    none_back = lambda c: F.nullif(c, F.lit(_NULL))
    pairs = (
        cells.groupBy(*keys, "row_idx", "col_idx")
        .agg(at(PRED).alias("pred"), at(GOLD).alias("gold"))
        .where("pred IS NOT NULL")
        .select(
            *keys,
            "row_idx",
            "col_idx",
            none_back(F.col("pred")).alias("pred"),
            none_back(F.coalesce("gold", F.lit(""))).alias("gold"),
        )
    )
    return compare_pairs(pairs.withColumn("is_geom", G.is_geometry(strip(F.col("gold")))))


def compare_pairs(pairs: DataFrame) -> DataFrame:
    """Strategy results for rows (pred, gold, is_geom)."""
    geom = F.col("is_geom")
    shown = pairs.withColumns({"_pt": F.when(geom, F.col("pred")), "_gt": F.when(geom, F.col("gold"))})
    decoded = shown.withColumns({"_p": G.decode_geom("_pt"), "_g": G.decode_geom("_gt")}).drop("_pt", "_gt")
    false = F.lit(False)
    return decoded.withColumns(
        {
            "as_text": F.when(geom, G.ewkt_equal("_p", "_g")).otherwise(false),
            "equals": F.when(geom, G.geom_equal("_p", "_g")).otherwise(false),
            "z": F.when(geom, G.z_equal(G.z_values("_p"), G.z_values("_g"))).otherwise(false),
            "value_match": F.when(~geom, G.text_equal("pred", "gold")).otherwise(false),
        }
    ).drop("_p", "_g")


def column_stats(
    compared: DataFrame, keys: Sequence[str] = KEYS, column_type: str = "whole"
) -> DataFrame:
    """Passes of every strategy per column and whether the column passes it.

    ``column_type="whole"``: a column is geometry when every non-blank expected cell is
    and there is one. ``"last_row"``: the last row alone decides.
    """
    blank = F.coalesce(strip(F.col("gold")), F.lit("")) == ""
    if column_type == "last_row":
        geometry = F.max_by("is_geom", "row_idx")
    else:
        geometry = (F.count_if(F.col("is_geom")) > 0) & (
            F.count_if(~F.col("is_geom") & ~blank) == 0
        )
    stats = compared.groupBy(*keys, "col_idx").agg(
        F.count_if("as_text").alias("ST_AsText_pass"),
        F.count_if("equals").alias("ST_Equals_pass"),
        F.count_if("z").alias("ST_Z_pass"),
        F.count_if("value_match").alias("value_match_pass"),
        F.count("*").alias("total_rows"),
        F.when(geometry, "geometry").otherwise("text").alias("column_type"),
    )
    return with_column_passes(stats)


def with_column_passes(stats: DataFrame) -> DataFrame:
    """Per column, which strategies pass for all of its rows."""
    geom = F.col("column_type") == "geometry"
    full = lambda c: F.col(c) == F.col("total_rows")
    return stats.withColumns(
        {
            "column_pass_by_st_astext": geom & full("ST_AsText_pass"),
            "column_pass_by_st_equals": geom & full("ST_Equals_pass"),
            "column_pass_by_st_z": geom & full("ST_Z_pass"),
            "column_pass_by_value_match": ~geom & full("value_match_pass"),
        }
    )


def strategy_rates(stats: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of the columns that pass each strategy."""
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 4)
    return stats.groupBy(*keys).agg(
        rate("column_pass_by_st_astext").alias("st_astext"),
        rate("column_pass_by_st_equals").alias("st_equals"),
        rate("column_pass_by_st_z").alias("st_z"),
        rate("column_pass_by_value_match").alias("value_match"),
    )


def column_ok() -> Column:
    """A geometry column needs text equality, or shape and Z equality; a text column its values."""
    return F.when(
        F.col("column_type") == "geometry",
        F.col("column_pass_by_st_astext")
        | (F.col("column_pass_by_st_equals") & F.col("column_pass_by_st_z")),
    ).otherwise(F.col("column_pass_by_value_match"))


def verdict(stats: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``correct`` when every column passes."""
    return stats.groupBy(*keys).agg(
        F.when(F.bool_and(column_ok()), "correct").otherwise("incorrect").alias("result_correct")
    )


# --- by matched columns --------------------------------------------------------------------


def geometry_columns(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, side, col_idx, is_geom): all non-blank cells decode and at least one does."""
    value = strip(F.col("value"))
    filled = F.coalesce(value, F.lit("")) != ""
    return (
        cells.withColumn("_text", F.when(G.is_geometry(value), value))
        .select(*keys, "side", "col_idx", filled.alias("_filled"), G.decode_geom("_text").isNotNull().alias("_geom"))
        .groupBy(*keys, "side", "col_idx")
        .agg(
            (F.bool_and(~F.col("_filled") | F.col("_geom")) & F.bool_or("_geom")).alias("is_geom")
        )
    )


def _fingerprint(value: Column) -> list[Column]:
    """Two independent mergeable hashes of a column's (row, value) cells."""
    return [
        F.bit_xor(F.xxhash64(F.lit(1), "row_idx", value)),
        F.bit_xor(F.xxhash64("row_idx", value, F.lit(2))),
    ]


def column_prints(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per result column with fingerprints of its content.

    ``text_print`` covers the cells' texts, ``ewkt_print`` their decoded geometries and
    ``shape_print`` the snapped shapes. Two columns agree row by row when their prints
    (128 bits and the row count) agree, so columns meet by an equi join and no cell is
    compared with the cells of all other columns. The prints are combined in the map
    tasks: a result of any length sends one row per column and partition.
    """
    value = strip(F.col("value"))
    prepared = cells.select(
        *keys,
        "side",
        "row_idx",
        "col_idx",
        "col_name",
        _shown(F.col("value")).alias("_text"),
        (F.coalesce(value, F.lit("")) != "").alias("_filled"),
        F.when(G.is_geometry(value), value).alias("_geometry"),
    ).withColumn("_wkt", G.decode_geom("_geometry")).select(
        "*",
        F.coalesce(G.canonical_text("_wkt"), F.lit(_NULL)).alias("_ewkt"),
        F.coalesce(G.snapped_form("_wkt"), F.lit(_NULL)).alias("_shape"),
    )
    one = lambda c: F.struct(F.count("*"), *_fingerprint(F.col(c)))
    return prepared.groupBy(*keys, "side", "col_idx").agg(
        F.max("col_name").alias("col_name"),
        F.count("*").alias("total_rows"),
        (
            F.bool_and(~F.col("_filled") | F.col("_wkt").isNotNull())
            & F.bool_or(F.col("_wkt").isNotNull())
        ).alias("is_geom"),
        one("_text").alias("text_print"),
        one("_ewkt").alias("ewkt_print"),
        one("_shape").alias("shape_print"),
    )


def compare_columns(prints: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per predicted column the gold columns with the same values (text columns).

    One row per predicted column: equal gold columns are listed, not paired off.
    """
    text = prints.where("NOT is_geom")
    golds = (
        text.where(_side(GOLD))
        .groupBy(*keys, "text_print")
        .agg(F.sort_array(F.collect_list("col_idx")).alias("gold_cols"))
    )
    return (
        text.where(_side(PRED))
        .join(golds, [*keys, "text_print"], "left")
        .select(
            *keys,
            F.col("col_idx").alias("pred_col"),
            F.coalesce("gold_cols", F.array().cast("array<int>")).alias("gold_cols"),
        )
    )


def _text_matches(prints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Text columns paired off: equal columns are one class, so the r-th predicted column
    of a class takes the r-th gold column. That is a maximum matching."""
    w = Window.partitionBy(*keys, "side", "text_print").orderBy("col_idx")
    ranked = prints.where("NOT is_geom").withColumn("_r", F.row_number().over(w))
    side = lambda s, name: ranked.where(_side(s)).select(
        *keys, "text_print", "_r", F.col("col_idx").alias(f"{name}_col"),
        *([F.col("total_rows")] if s == PRED else []),
    )
    return side(PRED, "pred").join(side(GOLD, "gold"), [*keys, "text_print", "_r"]).select(
        *keys,
        "pred_col",
        "gold_col",
        F.lit("text").alias("column_type"),
        "total_rows",
        F.lit(0).cast("bigint").alias("ST_AsText_pass"),
        F.lit(0).cast("bigint").alias("ST_Equals_pass"),
        F.lit(0).cast("bigint").alias("ST_Z_pass"),
        F.col("total_rows").alias("value_match_pass"),
    )


def geometry_edges(cells: DataFrame, prints: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Equal pairs of classes of geometry columns with their pass counts.

    Columns of one side with the same texts are a class, ``pred_cols`` or ``gold_cols``; its first
    column stands for it, so many copies of a column cost one comparison. Only pairs with equal
    snapped shapes can be equal (equal texts have equal shapes). The cells are read again for those
    pairs alone, to count text and Z passes: Z has a tolerance, which no fingerprint can express.
    """
    geom = prints.where("is_geom").groupBy(*keys, "side", "shape_print", "text_print")
    geom = geom.agg(F.array_sort(F.collect_list("col_idx")).alias("_cols"))
    side = lambda s, name: geom.where(_side(s)).select(
        *keys, "shape_print", F.col("_cols")[0].alias(f"{name}_col"), F.col("_cols").alias(f"{name}_cols")
    )
    pairs = side(PRED, "pred").join(side(GOLD, "gold"), [*keys, "shape_print"]).drop("shape_print")
    part = lambda s, name: cells.where(_side(s)).select(
        *keys, "row_idx", F.col("col_idx").alias(f"{name}_col"), F.col("value").alias(name)
    )
    rows = (
        pairs.join(part(PRED, "pred"), [*keys, "pred_col"])
        .join(part(GOLD, "gold"), [*keys, "gold_col", "row_idx"])
        .withColumn("is_geom", F.lit(True))
    )
    stats = compare_pairs(rows).groupBy(*keys, "pred_col", "gold_col").agg(
        F.first("pred_cols").alias("pred_cols"),
        F.first("gold_cols").alias("gold_cols"),
        F.count("*").alias("total_rows"),
        F.count_if("as_text").alias("ST_AsText_pass"),
        F.count_if("equals").alias("ST_Equals_pass"),
        F.count_if("z").alias("ST_Z_pass"),
    )
    full = lambda c: F.col(c) == F.col("total_rows")
    return stats.where(full("ST_AsText_pass") | (full("ST_Equals_pass") & full("ST_Z_pass")))


def _flows(edges: list[tuple[int, int]], supply: dict[int, int], room: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many columns of each predicted class go to each gold class, as many as possible in all.

    Classes have capacities, their numbers of columns. Each round finds a shortest path from a class
    with columns left to one with room left, taking back what it needs to, and sends along it all that
    it bears; so the work grows with the pairs of classes and not with their columns.
    """
    options: dict[int, list[int]] = {}
    for p, g in sorted(edges):
        options.setdefault(p, []).append(g)
    flow: dict[tuple[int, int], int] = {}
    holders: dict[int, set[int]] = {g: set() for g in room}
    left, free = dict(supply), dict(room)
    for start in options:
        while left[start]:
            came_from: dict[int, int] = {}
            through: dict[int, int | None] = {start: None}
            queue, end = deque([start]), None
            while queue and end is None:
                p = queue.popleft()
                for g in options[p]:
                    if g in came_from:
                        continue
                    came_from[g] = p
                    if free[g]:
                        end = g
                        break
                    for q in sorted(holders[g]):
                        if q not in through:
                            through[q] = g
                            queue.append(q)
            if end is None:
                break
            path, g = [], end
            while g is not None:
                p = came_from[g]
                path.append((p, g, through[p]))
                g = through[p]
            n = min([left[start], free[end], *(flow[p, back] for p, _, back in path if back is not None)])
            left[start] -= n
            free[end] -= n
            for p, g, back in path:
                flow[p, g] = flow.get((p, g), 0) + n
                holders[g].add(p)
                if back is not None:
                    flow[p, back] -= n
                    if not flow[p, back]:
                        holders[back].discard(p)
    return {k: n for k, n in flow.items() if n}


def match_columns(
    cells: DataFrame, keys: Sequence[str] = KEYS, prints: DataFrame | None = None
) -> DataFrame:
    """Every predicted column with a gold column of its own where one can be had.

    (keys, pred_col, gold_col, column_type, pass counts). Text columns are matched by
    counting. Geometry columns are matched by classes of equal columns, a row per pair of classes in a
    query's group; which column of a class goes where is numbered afterwards.
    ``prints`` are used several times: pass a stored table, or none to have one stored.
    """
    if prints is None:
        prints = materialize(column_prints(cells, keys), "prints")
    edges = geometry_edges(cells, prints, keys)
    taken = [T.StructField(c, T.IntegerType()) for c in ("_n", "_pred_at", "_gold_at")]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(pdf["pred_col"].tolist(), pdf["gold_col"].tolist(), strict=True))
        size = lambda c: dict(zip(pdf[f"{c}_col"].tolist(), pdf[f"{c}_cols"].map(len).tolist(), strict=True))
        flow = _flows(pairs, size("pred"), size("gold"))
        used: Counter[tuple[str, int]] = Counter()
        columns: list[tuple[int, int, int]] = []
        for p, g in pairs:
            n = flow.get((p, g), 0)
            columns.append((n, used["pred", p], used["gold", g]))
            used["pred", p] += n
            used["gold", g] += n
        out = pdf.assign(**{f.name: [c[k] for c in columns] for k, f in enumerate(taken)})
        return out[out["_n"] > 0]

    solved = edges.groupBy(*keys).applyInPandas(solve, T.StructType([*edges.schema.fields, *taken]))
    part = lambda c: F.slice(f"{c}_cols", F.col(f"_{c}_at") + 1, F.col("_n"))
    rest = [c for c in edges.columns if c not in (*keys, "pred_col", "gold_col", "pred_cols", "gold_cols")]
    numbered = solved.select(*keys, F.explode(F.arrays_zip(part("pred").alias("p"), part("gold").alias("g"))).alias("_pair"), *rest)
    geometry = numbered.select(
        *keys, F.col("_pair.p").alias("pred_col"), F.col("_pair.g").alias("gold_col"), *rest,
        F.lit("geometry").alias("column_type"), F.lit(0).cast("bigint").alias("value_match_pass"),
    )
    return _text_matches(prints, keys).unionByName(geometry)


def subset_verdict(
    prints: DataFrame, matches: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """``correct`` when every predicted column is matched; extra gold columns are allowed."""
    pred = prints.where(_side(PRED)).select(*keys, F.col("col_idx").alias("pred_col"), "col_name")
    joined = pred.join(
        matches.select(*keys, "pred_col", "gold_col"), [*keys, "pred_col"], "left"
    )
    missing = F.sort_array(
        F.collect_list(
            F.when(
                F.col("gold_col").isNull(),
                F.coalesce("col_name", F.col("pred_col").cast("string")),
            )
        )
    )
    message = F.concat(
        F.lit("Column subset match failed, unmatched pred columns: "),
        F.array_join("unmatched", ", "),
    )
    return (
        joined.groupBy(*keys)
        .agg(missing.alias("unmatched"))
        .select(
            *keys,
            F.when(F.size("unmatched") == 0, "correct").otherwise("incorrect").alias("result_correct"),
            F.when(F.size("unmatched") > 0, message).otherwise(F.lit("")).alias("execution_error"),
        )
    )
