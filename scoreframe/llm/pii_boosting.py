"""Personal data: fixed patterns, and boosted trees that choose among wider candidates.

High-recall generators propose spans that may overlap other kinds and the fixed ones. Gradient-boosted
trees weigh format (length, digits, check digit, ...) and context (the words before, the characters
around) of each candidate, taught by which candidates the fixed patterns confirm. The marks that the
fixed patterns ask for (a plus, an at sign, the sort of separators) are hidden from the trees: a number
without a plus scores like those with one that look alike and stand in like places. A threshold per
kind, set on candidates that weren't fitted so that at least ``PRECISION`` of those above it are
confirmed, selects further spans; the fixed ones always stay. Unconfirmed ones count as errors there,
so what is added is at most the rest of the kind's confirmed ones, and looks like them.

Everything on the main path is a column expression: candidates are found in the row of their
document, the trees become nested conditions, and no text is shuffled or meets Python. Texts are read
once; what is written for the later steps is the candidates alone. The trees are fitted on at most
``SAMPLE`` candidates, the thresholds on counts of all others. Patterns are anchored at the start of a run of their characters,
places are running sums in blocks and overlaps are found by one sort, so a very long text takes time in
proportion to its length, however many matches it has.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.sqltext import let as let_sql
from scoreframe.functions.sqltext import running_sums
from scoreframe.llm.common import stored

KINDS = ["email", "ip", "card", "phone"]
#: What counts as personal data. Starts are tied to the start of a run or the end of the last match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![^\s@()\[\]<>])[^\s@()\[\]<>]{1,64}+(?:@|[ ]?[(\[](?:at|AT)[)\]][ ]?)"
    r"[^\s@()\[\]<>.,;:!?]{1,63}+(?:(?:\.|[ ]?[(\[](?:dot|DOT)[)\]][ ]?)[^\s@()\[\]<>.,;:!?]{1,63}+)*+",
    "ip": r"(?<![0-9])[0-9]{1,4}+(?:[.,][0-9]{1,4}+){3,7}+",
    "card": r"(?<![0-9])[0-9](?:[ ./-]?[0-9]){11,22}+",
    "phone": r"(?<![0-9+])(?:\+|\(|00)?[0-9](?:[ ().\/-]{0,2}+[0-9]){6,17}+",
}
WORDS = {
    "email": "mail|contact|write",
    "ip": "ip|host|addr|server",
    "card": "card|visa|master|pay",
    "phone": "tel|phone|call|mobil|fax",
}
SAMPLE, PRECISION = 20_000, 0.99
ROUNDS, DEPTH, STEP = 10, 3, 0.3
SPAN = "struct<kind:string,start:int,end:int,value:string,left:string,right:string>"
PLAIN = "array<struct<kind:string,start:int,end:int>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def matches(text: str, pattern: str, kind: str) -> Column:
    """Leftmost matches of a text column that don't overlap, with their places in code points and what stands around them."""
    span = (
        f"named_struct('kind', '{kind}', 'start', get(ends, i) - length(v), 'end', get(ends, i), 'value', v, "
        "'left', right(get(gaps, i), 24), 'right', left(get(gaps, i + 1), 1))"
    )
    # A gap and the match behind it; the last gap has none.
    lengths = "zip_with(gaps, found, (g, v) -> length(g) + coalesce(length(v), 0))"
    placed = let_sql(lengths, "lens", let_sql(running_sums("lens"), "ends", f"transform(found, (v, i) -> {span})"))
    some = let_sql(f"split({text}, r'{pattern}', -1)", "gaps", placed)
    none = f"CAST(array() AS ARRAY<{SPAN}>)"
    found = f"regexp_extract_all({text}, r'({pattern})', 1)"
    return F.expr(let_sql(found, "found", f"CASE WHEN size(found) > 0 THEN CAST({some} AS ARRAY<{SPAN}>) ELSE {none} END"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return s + F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(False)


def _small_parts(value: Column) -> Column:
    """Every number of a dotted value is at most 255, however many zeros lead it."""

    def small(p: Column) -> Column:
        p = F.regexp_replace(p, "^0+", "")
        return (F.length(p) < 3) | (F.length(p) == 3) & (p <= "255")

    return F.forall(F.split(value, r"[.,]"), small)


def valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    checks = {
        "email": lambda: F.lit(True),
        "ip": lambda: _small_parts(value),
        "card": lambda: n.between(13, 19) & let(_digits(value), luhn),
        "phone": lambda: n.between(9, 15),
    }
    return checks[kind]()


def _valid_ones(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: valid(kind, s["value"]))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def confirmed(base: str, wide: str) -> Column:
    """``wide`` with a flag: whether a span of ``base`` overlaps it; both of one kind, in order and without overlaps of their own.

    Of the base spans that start in front of a span's end the last one reaches farthest. Its number is
    a running count over all starts and ends in order.
    """
    marks = (
        f"sort_array(concat(transform({base}, b -> named_struct('at', b.start, 'one', 1)), "
        f"transform({wide}, w -> named_struct('at', w.end, 'one', 0))))"
    )
    counts = "transform(filter(zip_with(marks, sums, (m, n) -> named_struct('one', m.one, 'n', n)), z -> z.one = 0), z -> z.n)"
    fields = ", ".join(f"'{f}', w.{f}" for f in ("kind", "start", "end", "value", "left", "right"))
    hit = f"coalesce(get({base}, get(counts, i) - 1).end > w.start, false)"
    flagged = let_sql(counts, "counts", f"transform({wide}, (w, i) -> named_struct({fields}, 'confirmed', {hit}))")
    summed = let_sql("transform(marks, m -> m.one)", "ones", let_sql(running_sums("ones"), "sums", flagged))
    return F.expr(let_sql(marks, "marks", summed))


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``base`` (valid fixed spans in order) and ``wide`` (proposed spans, whether confirmed), per row."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), text.alias("text"))
    base = [_valid_ones(matches("text", BASE[k], k), k).alias(f"base_{k}") for k in KINDS]
    rows = rows.select("doc_id", *base, *[matches("text", WIDE[k], k).alias(f"wide_{k}") for k in KINDS])
    wide = F.concat(*[confirmed(f"base_{k}", f"wide_{k}") for k in KINDS])
    return rows.select("doc_id", plain(F.concat(*[f"base_{k}" for k in KINDS])).alias("base"), wide.alias("wide"))


def plain(spans: Column) -> Column:
    cut = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return F.transform(spans, cut).cast(PLAIN)


def unmarked(s: Column) -> Column:
    """A span's value without the marks that tell the fixed patterns' matches from others like them."""
    email = F.regexp_replace(s["value"], r"[ ]?[(\[](?:at|AT)[)\]][ ]?", "@")
    email = F.regexp_replace(email, r"[ ]?[(\[](?:dot|DOT)[)\]][ ]?", ".")
    number = F.regexp_replace(F.regexp_replace(s["value"], r"^(?:\+|\(|00)", ""), r"[ ().\/-]+", " ")
    return F.when(s["kind"] == "email", email).when(s["kind"] == "ip", F.translate(s["value"], ",", ".")).otherwise(number)


def features(s: Column) -> Column:
    """Format and context of a span, as an array of numbers; nothing in it tells a marked value from an unmarked one."""
    return let(unmarked(s), lambda value: F.array(*_features(s, value)))


def _features(s: Column, value: Column) -> list[Column]:
    digits = _digits(value)
    count = lambda chars: F.length(value) - F.length(F.translate(value, chars, ""))
    out = [(s["kind"] == k).cast("double") for k in KINDS]
    out += [F.length(value).cast("double"), F.length(digits).cast("double")]
    out += [count(c).cast("double") for c in (".", " ", "-")]
    out += [
        F.length(F.regexp_replace(value, "[^A-Za-z]", "")).cast("double"),
        F.length(F.regexp_replace(value, "[A-Za-z0-9._%+@ -]", "")).cast("double"),
        F.length(F.substring_index(value, ".", -1)).cast("double"),
        # A check that belongs to one kind says nothing of the others.
        ((s["kind"] == "card") & let(digits, luhn)).cast("double"),
        ((s["kind"] == "ip") & _small_parts(value)).cast("double"),
        F.size(F.array_distinct(F.split(digits, ""))).cast("double"),
        F.rlike(F.right(s["left"], F.lit(1)), F.lit(r"[\s(:]|^$")).cast("double"),
        F.rlike(s["right"], F.lit(r"[\s),;.]|^$")).cast("double"),
    ]
    out += [F.rlike(F.lower(s["left"]), F.lit(WORDS[k])).cast("double") for k in KINDS]
    return [F.coalesce(c, F.lit(0.0)) for c in out]


def _tree(node, x: Column) -> Column:
    """A fitted tree as nested conditions."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    left, right = _tree(node.leftChild(), x), _tree(node.rightChild(), x)
    return F.when(x[split.featureIndex()] <= float(split.threshold()), left).otherwise(right)


class Booster:
    """Fitted trees and thresholds as column expressions; without trees it selects nothing."""

    def __init__(self, trees: list, weights: list[float], thresholds: dict[str, float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def score(self, span: Column) -> Column:
        """Probability that a candidate is personal data."""

        def total(x: Column) -> Column:
            parts = [_tree(t, x) * w for t, w in zip(self.trees, self.weights, strict=True)]
            return 1 / (1 + F.exp(-2 * reduce(lambda a, b: a + b, parts)))

        return let(features(span), total)

    def selects(self, span: Column) -> Column:
        if not self.trees or not self.thresholds:
            return F.lit(False)
        least = reduce(lambda c, k: c.when(span["kind"] == k, self.thresholds[k]), self.thresholds, F.when(F.lit(False), 2.0))
        return self.score(span) >= least.otherwise(2.0)


def fit(found: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> Booster:
    """Trees on a bounded sample of the candidates, thresholds on all candidates that aren't fitted.

    A candidate is confirmed if it overlaps a valid fixed span of its kind. The sample takes different
    values and contexts, evenly per kind, and leaves a quarter of them out. Kinds whose candidates are
    all of one sort, or too few to calibrate, get no threshold.
    """
    rows = found.select(F.explode("wide").alias("s"))
    label = F.col("s.confirmed").cast("double")
    # What the features see: copies of a value in its context have one rank.
    rank = F.xxhash64("s.kind", "s.value", "s.left", "s.right")
    rows = rows.select("s", rank.alias("rank"), label.alias("label"))
    apart = rows.where(F.pmod("rank", F.lit(4)) > 0).groupBy("s.kind", "rank")
    apart = stored(apart.agg(F.min("s").alias("s"), F.max("label").alias("label")), "different")
    parts = [apart.where(F.col("kind") == k).orderBy("rank").limit(sample // len(KINDS)) for k in KINDS]
    chosen = reduce(DataFrame.unionByName, parts)
    fitted = stored(chosen.select("rank", "label", features(F.col("s")).alias("x")), "sample")
    n = len(_features(F.col("s"), F.col("s.value")))
    if fitted.select("label").distinct().count() < 2:
        return Booster([], [], {})
    names = [f"f{k}" for k in range(n)]
    flat = fitted.select("label", *[F.col("x")[k].alias(names[k]) for k in range(n)])
    flat = VectorAssembler(inputCols=names, outputCol="features").transform(flat)
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=STEP, seed=7, cacheNodeIds=False).fit(flat.select("label", "features"))
    booster = Booster([t._java_obj.rootNode() for t in model.trees], model.treeWeights, {})
    aside = rows.join(F.broadcast(fitted.select("rank")), "rank", "left_anti")
    step = F.floor(booster.score(F.col("s")) * 200).cast("int")
    table = aside.select("s.kind", step.alias("step"), "label").groupBy("kind", "step")
    table = table.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).collect()
    for kind in KINDS:
        n = good = 0
        for r in sorted((r for r in table if r["kind"] == kind), key=lambda r: -r["step"]):
            n, good = n + r["n"], good + r["good"]
            if good >= precision * n and n >= 20:
                booster.thresholds[kind] = r["step"] / 200
    return booster


def redactions(found: DataFrame, booster: Booster) -> DataFrame:
    """``doc_id, base, spans``: the fixed spans and those selected, per kind in order of start.

    Candidates of one kind don't overlap each other, and those that overlap a fixed span of their kind
    are that span already, so spans of one kind never overlap.
    """
    more = F.filter("wide", lambda s: ~s["confirmed"] & booster.selects(s))

    def merge(every: Column) -> Column:
        return F.concat(*[F.array_sort(of_kind(every, k)) for k in KINDS])

    return found.select("doc_id", "base", let(F.concat("base", plain(more)), merge).alias("spans"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every whole text: ``doc_id, base, spans`` (kind, start, end in code points).

    Null texts count as empty and have no spans; repeated rows get equal results; other columns are not
    read; without candidates of both sorts the fixed patterns decide alone.
    """
    found = stored(candidates(docs, id_col, text_col), "candidates")
    return redactions(found, fit(found))


def mask(text: str, spans: str) -> Column:
    """The text column with the spans of another (any kinds, any order) replaced by their kinds in brackets.

    Spans that overlap are one, named by the kind that starts first. Pieces are cut from blocks of the
    text, because a place in a text is counted from its front.
    """
    marks = (
        f"sort_array(concat(transform({spans}, s -> named_struct('at', s.start, 'step', 1, 'end', s.end, 'kind', s.kind)), "
        f"transform({spans}, s -> named_struct('at', s.end, 'step', -1, 'end', s.end, 'kind', s.kind))))"
    )
    deep = "zip_with(marks, sums, (m, d) -> named_struct('at', m.at, 'step', m.step, 'kind', m.kind, 'depth', d))"
    edges = "filter(deep, e -> e.depth = 0 AND e.step = -1 OR e.depth = 1 AND e.step = 1)"
    size = 4096
    blocks = f"transform(sequence(0, length({text}), {size}), b -> substring({text}, b + 1, {size}))"
    near = f"array_join(transform(sequence(a DIV {size}, b DIV {size}), k -> coalesce(get(blocks, CAST(k AS INT)), '')), '')"
    piece = let_sql("coalesce(get(edges, i - 1).at, 0)", "a", let_sql("get(edges, i).at", "b", f"substring({near}, a % {size} + 1, b - a)"))
    last = let_sql("coalesce(element_at(edges, -1).at, 0)", "a", let_sql(f"length({text})", "b", f"substring({near}, a % {size} + 1, b - a)"))
    told = f"transform(edges, (e, i) -> CASE WHEN e.step = 1 THEN concat({piece}, '[', e.kind, ']') ELSE '' END)"
    joined = let_sql(blocks, "blocks", f"concat(array_join({told}, ''), {last})")
    summed = let_sql(running_sums("steps"), "sums", let_sql(deep, "deep", let_sql(edges, "edges", joined)))
    whole = let_sql(marks, "marks", let_sql("transform(marks, m -> m.step)", "steps", summed))
    return F.expr(f"CASE WHEN size({spans}) > 0 THEN {whole} ELSE {text} END")


def digest(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
