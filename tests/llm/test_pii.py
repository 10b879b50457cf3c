import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from scoreframe.llm import pii_boosting as pii

from . import awkward

RE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, v):
    n = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    return {"email": True, "card": 13 <= len(n) <= 19 and luhn(n), "phone": 9 <= len(n) <= 15}[kind]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k in RE for m in re.finditer(RE[k], text or "") if valid(k, m.group())]


TEXTS = [
    "a@b.c_d@e.f g@h", "a@b.c@d.e", "@@x@y.z.", "日本 é bob+1%@ex-a.co.uk, x@y", "1.2.3.4.5.6.7.8 300.1.1.1 0001.02.255.0 256.1.1.1", "1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 5500005555555559", "4111  1111 1111 1111", "41111111111111111111111111", "+1 (202) 555-0123. +12 +1-2-3",
    "++1 202 555 0123x +99999999999999999", "tel 12-34 5 6-7 8 9 0 1 2 3 4", "9" * 5000, "a." * 3000 + "@b.c", "+" + "1 " * 2000,
]


def table():
    r = random.Random(6)
    bits = ["a@b.c", "@", ".", "1.2.3.4", "255", "256", " ", "-", "4111111111111111", "+1", "(", ")", "5", "é", "x", "\n", "日", "_"]
    texts = [*TEXTS, *("".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(400))]
    for k in range(150):
        texts.append(f"call me at +1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)} or mail p{k}@mail.example.com from 10.0.{k}.7 now")
        texts.append(f"order {r.randint(10**12, 10**13)} in {r.randint(1, 999)}.{r.randint(300, 999)} of version 3.{k}.9.1200")
    return list(enumerate(texts)) + awkward_rows()


def awkward_rows():
    return [r[:2] for r in awkward.rows()]


def test_base_spans_by_brute_force(spark):
    rows = table()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pii.find(docs).select("doc_id", pii.digest(F.col("base")).alias("b"), pii.digest(F.col("spans")).alias("s")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.b) for r in got) == sorted(
        (i is None, i or 0, ",".join(brute(t))) for i, t in rows
    )
    for r in got:
        assert set(r.b.split(",")) <= set(r.s.split(",")) | {""}
        spans = [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in r.s.split(",") if s]
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        for a, b in zip(spans, spans[1:], strict=False):
            assert a[0] != b[0] or a[2] <= b[1]


def test_trees_select_what_looks_alike(spark):
    """Candidates like the confirmed ones pass, unlike ones don't, and overlaps are settled."""
    rows = table()
    found = pii.candidates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    booster = pii.fit(found, precision=0.9)
    assert booster.trees and booster.thresholds
    scored = found.select("base", F.explode("wide").alias("s"))
    got = scored.select("base", "s", F.col("s.confirmed").alias("y"), booster.score(F.col("s")).alias("p")).collect()
    for r in got:
        assert r.y == any(b.kind == r.s.kind and b.start < r.s.end and r.s.start < b.end for b in r.base)
    assert all(0 <= r.p <= 1 for r in got)
    right = sum((r.p > 0.5) == r.y for r in got)
    assert right > 0.9 * len(got)
    every = pii.Booster(booster.trees, booster.weights, {k: 0.0 for k in pii.KINDS})
    for r in pii.redactions(found, every).collect():
        spans = sorted((s.kind, s.start, s.end) for s in r.spans)
        assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False))
        assert {(s.kind, s.start, s.end) for s in r.base} <= set(spans)


def test_mask(spark):
    docs = spark.createDataFrame([(1, "é a@b.co and 10.1.2.3!"), (2, "none"), (3, "a@1.2.3.4")], "doc_id long, text string")
    found = pii.find(docs).withColumnRenamed("doc_id", "k")
    rows = docs.join(found, F.col("doc_id") == F.col("k")).select("doc_id", pii.mask("text", "spans").alias("t"))
    assert dict(rows.collect()) == {1: "é [email] and [ip]!", 2: "none", 3: "[email]"}


def test_awkward(spark):
    got = pii.find(awkward.docs(spark))
    assert got.count() == len(awkward.rows())
    assert pii.find(awkward.empty(spark)).count() == 0


def test_plan_stays_native(spark):
    docs = spark.createDataFrame(table()[:20], "doc_id long, text string")
    plan = pii.candidates(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert hashlib.sha256(b"").hexdigest() == docs.limit(1).select(F.sha2(pii.digest(F.array().cast("array<struct<kind:string,start:int,end:int>>")), 256)).first()[0]


def test_thresholds_cover_all_candidates(spark):
    """A rare kind keeps its threshold however small the sample, and copies of a text take one place in it."""
    rows = table()[: len(TEXTS) + 400 + 300]
    rows += [(10_000 + k, "card 4111 1111 1111 1111 or version 3.7.9.1200 of 2025") for k in range(2000)]
    found = pii.candidates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    booster = pii.fit(found, sample=200, precision=0.9)
    assert {"ip", "email"} <= set(booster.thresholds)
    aside = found.select("base", F.explode("wide").alias("s")).where("s.kind = 'ip'")
    good = F.col("s.confirmed").cast("int")
    over = aside.where(booster.score(F.col("s")) >= booster.thresholds["ip"]).agg(F.count(good), F.avg(good)).first()
    assert over[0] >= 20 and over[1] >= 0.85


def test_unmarked_spans_are_added(spark):
    """An address with a bracketed at sign and a number without a plus join those that look like them; other numbers don't."""
    r = random.Random(4)
    rows = []
    for k in range(1500):
        number = f"{r.randint(10, 99)} {r.randint(200, 999)} 555 {r.randint(1000, 9999)}"
        rows.append((k, f"please call me at tel +{number}, mail me{k}@mail{k % 9}.example.com or so"))
        rows.append((2000 + k, f"order {r.randint(10**9, 10**10)} of {r.randint(10**9, 10**10)} pieces, see x{k}@y and (at) z"))
    planted = {5000: "john77(at)mail3.example.com", 5001: "john78[at]mail4[dot]example.com"}
    planted = {i: (f"please call me at tel 44 207 555 123{i % 10}, mail {v} or so", v) for i, v in planted.items()}
    rows += [(i, t) for i, (t, _) in planted.items()]
    got = {g.doc_id: g for g in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (text, value) in planted.items():
        assert got[i].base == []
        assert [(s.kind, text[s.start : s.end]) for s in got[i].spans] == [("email", value), ("phone", f"44 207 555 123{i % 10}")]
    assert all(g.spans == g.base for i, g in got.items() if i < 5000)


def test_many_matches_in_one_text(spark):
    """Twenty times the matches take about twenty times the time, masked and whole."""
    took = []
    for n in (2000, 40_000):
        text = " ".join(f"a{k}@b{k}.com" for k in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        started = time.monotonic()
        got = pii.candidates(docs, "doc_id", "text").select("base", F.filter("wide", lambda s: s["confirmed"]).alias("w")).first()
        took.append(time.monotonic() - started)
        assert [text[s.start : s.end] for s in got.base] == text.split() == [s.value for s in got.w if s.kind == "email"]
    assert took[1] < 20 * max(took[0], 0.5) * 2
    found = docs.withColumn("spans", pii.matches("text", pii.BASE["email"], "email"))
    assert found.select(pii.mask("text", "spans").alias("t")).first().t == " ".join(["[email]"] * n)


def test_mask_by_brute_force(spark):
    r = random.Random(9)
    rows = []
    for k in range(60):
        text = "".join(r.choice("ab é日") for _ in range(r.choice([0, 5, 40, 9000])))
        spans = []
        for _ in range(r.randint(0, 6) if text else 0):
            a = r.randrange(len(text))
            spans.append((r.choice(pii.KINDS), a, r.randint(a + 1, len(text))))
        rows.append((k, text, spans))
    df = spark.createDataFrame(rows, f"k int, text string, spans {pii.PLAIN}")
    got = dict(df.select("k", pii.mask("text", "spans").alias("t")).collect())
    for k, text, spans in rows:
        out, at = "", 0
        for a, b, kind in sorted((a, b, kind) for kind, a, b in spans):
            if a >= at:
                out += text[at:a] + f"[{kind}]"
            at = max(at, b)
        assert got[k] == out + text[at:]
