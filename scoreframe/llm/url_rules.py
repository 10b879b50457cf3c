"""URL filtering by association rules that FP-growth mines from labelled pages, and a fixed rule list.

Labelled URLs become sets of tokens; FP-growth finds frequent sets with and without the block label,
and sets whose share of blocked pages (confidence) and number of pages (support) are high enough
become rules. An inverted index keeps each rule under its rarest token; a page's tokens find the
rules, which are then checked whole.

At scale: supports come from all labelled pages. Every host label, path segment and query key is a
token; the mining is bounded by support alone: FP-growth first drops the tokens below it, which
changes no frequent set. Rules are matched against distinct token sets, in which numbers are folded,
so the pages of one large site count once; only sets that a rule fits are joined back to the pages.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import LOWER, UPPER, stored

MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
#: Blocked pages a rule needs besides its share, so that chance makes no rule of a few pages.
MIN_PAGES = 20
BLOCKED = "!block"

#: Host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null and for texts without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Sorted, distinct tokens of a URL: ending, domain, first and all other host labels, path segments, query keys."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    # The first and the last label have tokens of their own.
    labels = F.filter(F.slice(labels, 2, F.greatest(F.size(labels) - 2, F.lit(0))), lambda x: x != "")
    segments = F.filter(F.split(F.lower(path), "/"), lambda s: s != "")
    keys = F.transform(F.split(query, "&"), lambda p: F.lower(F.substring_index(p, "=", 1)))
    keys = F.filter(keys, lambda k: k != "")
    parts = [
        F.array(
            F.concat(F.lit("end:"), F.substring_index(host, ".", -1)),
            F.concat(F.lit("domain:"), F.substring_index(host, ".", -2)),
            F.concat(F.lit("first:"), F.substring_index(host, ".", 1)),
        ),
        F.transform(labels, lambda x: F.concat(F.lit("label:"), x)),
        F.transform(segments, lambda s: F.concat(F.lit("path:"), F.regexp_replace(s, "[0-9]+", "#"))),
        F.transform(keys, lambda k: F.concat(F.lit("key:"), k)),
    ]
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.concat(*parts))))


def mine_rules(
    labelled: DataFrame, url_col: str = "url", block_col: str = "block",
    min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``items, key, confidence, support`` of each rule; rows without host or label teach nothing.

    A set with the block label has to be on ``min_pages`` pages and on the share ``min_support`` of all.
    """
    rows = labelled.select(tokens(labelled[url_col]).alias("t"), labelled[block_col].cast("boolean").alias("b"))
    rows = rows.where("size(t) > 0 AND b IS NOT NULL")
    rows = stored(rows.select(F.when(F.col("b"), F.array_append("t", F.lit(BLOCKED))).otherwise(F.col("t")).alias("items")), "urls")
    share = min(max(min_support, min_pages / max(rows.count(), 1)), 1.0)
    sets = FPGrowth(itemsCol="items", minSupport=share).fit(rows).freqItemsets
    sets = stored(sets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n")), "sets")
    blocked = sets.where(F.array_contains("items", BLOCKED) & (F.size("items") > 1))
    blocked = blocked.select(F.array_remove("items", BLOCKED).alias("items"), F.col("n").alias("blocked"))
    rules = sets.join(blocked, "items").select("items", (F.col("blocked") / F.col("n")).alias("confidence"), F.col("n").alias("support"))
    rules = rules.where(F.col("confidence") >= min_confidence)
    alone = sets.where("size(items) = 1").select(F.col("items")[0].alias("token"), F.col("n").alias("often"))
    rare = rules.select("*", F.explode("items").alias("token")).join(alone, "token")
    return rare.groupBy("items", "confidence", "support").agg(F.min(F.struct("often", "token"))["token"].alias("key"))


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The token sets that a rule fits: ``tokens``, the best rule's ``items`` and ``confidence``."""
    index = rules.select("key", F.col("items").alias("need"), "confidence")
    found = sets.select("tokens", F.explode("tokens").alias("key")).join(index, "key")
    found = found.where(F.size(F.array_except("need", "tokens")) == 0)
    best = F.max(F.struct("confidence", "need"))
    return found.groupBy("tokens").agg(best.alias("m")).select("tokens", F.col("m.need").alias("items"), "m.confidence")


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits as a struct ``(…, rule, verdict)``, or null.

    A rule fits its host and all hosts below it if the path starts with the rule's. Of rules of one
    length that with the longer host wins, then block. The list is an argument, so it is part of the plan.
    """
    if not rules:
        return F.lit(None).cast("struct<size:int,host:int,block:int,rule:string,verdict:string>")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for h, p, verdict in rules:
        by_host.setdefault(h, []).append((p, verdict))
    options = [
        (h, F.array(*[F.struct(
            F.lit(len(h + p)).alias("size"), F.lit(len(h)).alias("host"), F.lit(int(v == "block")).alias("block"),
            F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("path")) for p, v in of]))
        for h, of in by_host.items()
    ]
    table = F.create_map(*[c for h, of in options for c in (F.lit(h), of)])
    ends = F.transform(F.sequence(F.lit(1), F.size(F.split(host, r"\."))), lambda i: F.call_function("substring_index", host, F.lit("."), -i))
    fitting = F.flatten(F.filter(F.transform(F.array_distinct(ends), lambda e: table[e]), lambda a: a.isNotNull()))
    return F.array_max(F.filter(fitting, lambda r: F.startswith(path, r["path"])))


def judge(
    pages: DataFrame, mined: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, mined`` (the mined rule's tokens).

    The fixed rule decides if one fits; else a mined rule blocks, and pages that none fits are
    allowed. Null urls and those without ``://`` have no tokens; repeated rows are judged one by one.
    """
    host, path = host_and_path(pages[url_col])
    rows = pages.select(
        pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"), tokens(pages[url_col]).alias("tokens")
    )
    hits = stored(match_rules(rows.select("tokens").distinct(), stored(mined, "rules")), "hits")
    rows = rows.join(hits.select("tokens", F.col("items").alias("mined")), "tokens", "left")
    fixed = rows.select("page_id", "host", "path", "mined", fixed_rule(F.col("host"), F.col("path"), rules).alias("f"))
    own = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return fixed.select(
        "page_id", "host", "path", F.col("f.rule").alias("rule"), F.coalesce("f.verdict", own).alias("verdict"), "mined"
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Urls of labelled pages; a page is to be blocked if it is toxic or of low quality by any label."""
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    known = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("block"))
    return pages.select("page_id", "url").join(known, "page_id")
