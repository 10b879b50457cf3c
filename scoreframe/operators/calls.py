"""Function calls in predicted SQL and how their argument types fit the signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext as S
from ..functions.exprtypes import expression_type

UNKNOWN_TYPE = "ERROR: type of the expression is not known"
_TEXTS = "array<string>"


def _empty() -> Column:
    return F.array().cast(_TEXTS)


def with_calls(
    df: DataFrame, sql: str = "pred_sql", name: str = "calls", target: str | None = None
) -> DataFrame:
    """Add array<struct<fn, args>> of all closed calls in text order, nested ones included,
    and ``structure_valid``. ``target`` names a column: only calls of its function are kept,
    any case."""
    groups = S.closed_groups("ps", S.CALL_LEAD, target)
    found = S.let(
        "_pieces",
        "ps",
        rf"transform({groups}, g -> named_struct('fn', lower(regexp_replace(g.name, r'\s+', '')), "
        f"'args', transform(g.items, i -> {S.unmasked('i')})))",
    )
    return (
        df.withColumn("_pieces", S.paren_pieces(sql))
        .withColumns(
            {name: F.expr(found), "structure_valid": S.structure_valid(sql, "_pieces")}
        )
        .drop("_pieces")
    )


def calls(df: DataFrame, keys: Sequence[str], target: str, sql: str = "pred_sql") -> DataFrame:
    """(keys, fn, call_idx, args): the calls whose name equals ``target`` (a column), any case."""
    found = with_calls(df, sql, "_hits", target)
    rows = found.select(*keys, F.posexplode_outer("_hits").alias("call_idx", "_c"))
    return rows.where("call_idx IS NOT NULL").select(
        *keys, F.col("_c.fn").alias("fn"), "call_idx", F.col("_c.args").alias("args")
    )


def first_call(df: DataFrame, target: str = "function_name_used", sql: str = "pred_sql") -> DataFrame:
    """Add ``structure_valid``, ``function_hit`` and the ``args`` of the first call of the target."""
    return (
        with_calls(df, sql, "_hits", target)
        .withColumn("_hit", F.get("_hits", F.lit(0)))
        .withColumn("function_hit", F.col("structure_valid") & F.col("_hit").isNotNull())
        .withColumn("args", F.when(F.col("function_hit"), F.col("_hit.args")))
        .drop("_hit", "_hits")
    )


_RETURNS = "array<struct<types:array<string>,returned:string>>"


def return_lists(returns: DataFrame) -> DataFrame:
    """One row per function: ``_fn`` and ``_returns``, its different return types by parameter types.

    ``returns`` has (function_name, return_type) and may have input_types, the parameters of that overload.
    """
    types = F.col("input_types") if "input_types" in returns.columns else F.lit(None).cast(_TEXTS)
    one = F.struct(types.alias("types"), F.col("return_type").alias("returned"))
    return returns.groupBy(F.lower("function_name").alias("_fn")).agg(F.collect_set(one).alias("_returns"))


def arg_types(
    df: DataFrame, keys: Sequence[str] = (), returns: DataFrame | None = None, args: str = "args"
) -> DataFrame:
    """Add ``actual_arg_types``: the type of each argument taken alone, from the inside out.

    Casts, literals, operators, CASE and ARRAY are typed by rule, calls by ``returns`` (see
    :func:`return_lists`; of overloads that fit equally well the least type counts). All else, such as a column or an
    operator next to one, has an ``ERROR`` type. Rows with nested calls meet the functions they name in one join and come
    back together by a number of their own, so the calls are parsed once; ``keys`` isn't needed any more and is kept for callers.
    """
    known = f"map<string,{_RETURNS}>"
    if returns is None:
        found = df.withColumn("_known", F.expr(f"CAST(map() AS {known})"))
    else:
        called = rf"array_distinct(transform(regexp_extract_all(array_join({args}, ' '), r'([A-Za-z_][\w.]*)\s*\(', 1), n -> lower(n)))"
        rows = df.withColumn("_n", F.monotonically_increasing_id()).withColumn("_fn", F.explode_outer(F.expr(called)))
        rows = rows.select("_n", "_fn", F.struct(*df.columns).alias("_row")).join(return_lists(returns), "_fn", "left")
        entry = F.when(F.col("_returns").isNotNull(), F.struct("_fn", "_returns"))
        found = rows.groupBy("_n").agg(F.first("_row").alias("_row"), F.map_from_entries(F.collect_list(entry)).alias("_known"))
        found = found.select("_row.*", "_known")
    typed = f"transform({args}, a -> coalesce({expression_type('a', '_known')}, '{UNKNOWN_TYPE}'))"
    return found.withColumn("actual_arg_types", F.expr(typed)).drop("_known")


# --- matching against signatures ---------------------------------------------------------------


def padded(expected: Column, variadic: Column, n: Column) -> Column:
    """Expected types of ``n`` arguments: a variadic list repeats its last type."""
    extra = F.when(
        variadic & (n > F.size(expected)),
        F.array_repeat(F.try_element_at(expected, F.lit(-1)), n - F.size(expected)),
    )
    return F.concat(expected, F.coalesce(extra, _empty()))


def type_match(actual: Column, expected: Column) -> Column:
    """Equal positions; for lists of one length this over the length is the ratio."""
    return F.size(
        F.filter(F.zip_with(actual, expected, lambda a, e: a == e), lambda ok: F.coalesce(ok, F.lit(False)))
    )


def match_ratio(actual: Column, expected: Column, variadic: Column) -> Column:
    """Share of arguments with the expected type; no arguments expected and none given is 1."""
    full = padded(expected, variadic, F.size(actual))
    return F.when((F.size(full) == 0) & (F.size(actual) == 0), 1.0).otherwise(
        F.try_divide(type_match(actual, full), F.size(full).cast("double"))
    )


def match_detail(actual: Column, expected: Column, variadic: Column) -> Column:
    """``✔ type`` or ``✘ actual ≠ expected`` per argument."""
    return F.zip_with(
        actual,
        padded(expected, variadic, F.size(actual)),
        lambda a, e: F.when(a == e, F.concat(F.lit("✔ "), a)).otherwise(
            F.concat(F.lit("✘ "), a, F.lit(" ≠ "), e)
        ),
    )


def join_signatures(
    df: DataFrame, signatures: DataFrame, fn: str = "function_name", how: str = "inner"
) -> DataFrame:
    """Rows with every overload of their function that takes that many arguments.

    Names compare without case. A variadic overload takes its own number or more.
    """
    sigs = signatures.select(
        F.lower("function_name").alias("_fn"),
        F.col("input_types").alias("expected_types"),
        "variadic",
        "sig_ord",
    )
    n, m = F.size("actual_arg_types"), F.size("expected_types")
    takes = F.when(F.col("variadic"), n >= m).otherwise(n == m)
    return df.join(sigs, (F.lower(F.col(fn)) == F.col("_fn")) & takes, how).drop("_fn")


def signature_lists(signatures: DataFrame) -> DataFrame:
    """One row per function: ``_fn`` and ``_sigs``, its distinct overloads by their least order.

    Listing the same types twice says nothing new, so a name has as many entries as it has
    different parameter lists, however often the input repeats them.
    """
    distinct = signatures.groupBy(
        F.lower("function_name").alias("_fn"), F.col("input_types").alias("types"), "variadic"
    ).agg(F.min("sig_ord").alias("ord"))
    return distinct.groupBy("_fn").agg(
        F.array_sort(F.collect_list(F.struct("ord", "types", "variadic"))).alias("_sigs")
    )


def best_signature(
    df: DataFrame, signatures: DataFrame, keys: Sequence[str] = (), fn: str = "function_name"
) -> DataFrame:
    """Best overload per row: highest ratio, the first listed on ties, none at ratio 0.

    Adds ``param_type_match_ratio``, ``expected_arg_types`` and ``param_type_match_detail``.
    The overloads of a function travel in one row, so the output has the rows of the input;
    ``keys`` isn't needed any more and is kept for callers.
    """
    actual = F.col("actual_arg_types")

    def rated(s: Column) -> Column:
        n, m = F.size(actual), F.size(s["types"])
        takes = F.when(s["variadic"], n >= m).otherwise(n == m)
        ratio = F.when(takes, match_ratio(actual, s["types"], s["variadic"])).otherwise(0.0)
        return F.struct(ratio.alias("ratio"), (-s["ord"]).alias("ord"), s["types"].alias("types"), s["variadic"].alias("variadic"))

    fitting = F.filter(F.transform("_sigs", rated), lambda r: r["ratio"] > 0)
    joined = df.join(signature_lists(signatures), F.lower(F.col(fn)) == F.col("_fn"), "left")
    b = F.col("_best")
    return (
        joined.withColumn("_best", F.array_max(fitting))
        .withColumns(
            {
                "param_type_match_ratio": F.round(F.coalesce(b["ratio"], F.lit(0.0)), 4),
                "expected_arg_types": F.coalesce(b["types"], _empty()),
                "param_type_match_detail": F.when(
                    b.isNotNull(), match_detail(actual, b["types"], b["variadic"])
                ).otherwise(_empty()),
            }
        )
        .drop("_best", "_fn", "_sigs")
    )


def score_calls(
    df: DataFrame, signatures: DataFrame, keys: Sequence[str], returns: DataFrame | None = None
) -> DataFrame:
    """Semantic result per prediction with ``function_name_used`` and ``pred_sql``."""
    typed = arg_types(first_call(df), keys, returns)
    scored = best_signature(typed, signatures, keys, "function_name_used")
    own = [F.col("semantic_error")] if "semantic_error" in df.columns else []
    return scored.withColumn(
        "semantic_error",
        F.coalesce(
            *own,
            F.when(~F.col("structure_valid"), F.lit("AST parse failed: not a closed statement")),
            F.when(~F.col("function_hit"), F.lit("Function not found")),
            F.lit(""),
        ),
    )
