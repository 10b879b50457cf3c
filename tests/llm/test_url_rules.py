import random
import re

from scoreframe.llm import url_rules


def brute(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return re.sub("[A-Z]+", lambda m: m.group().lower(), host), path


def rule_of(host, path, rules):
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://COM", "https://A.Example.com/en/1?x#y", "https://www.example.com/en/", "http://www.example.com/EN/",
    "http://x.www.example.com/en/q", "ftp://example.com", "http://example.com?q=/en/", "http://net/es/", "http://a.net/fr/x#", "http://a.net/fr",
    "http://ünï.NET/es/ä", "http://notexample.com/en/", "http://a.com://b/", "x://y.org/p?k=1&k=2&z", "http://a..com/", "http://com./", "http://a\nb.com/\n/",
]


def test_hosts_and_rules(spark):
    rows = [(k, u, "c", "c") for k, u in enumerate(URLS)] + [(None, URLS[5], "c", "c"), (5, URLS[5], "c", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, tokens string, verdict string")
    none = spark.createDataFrame([], "items array<string>, confidence double, support long, key string")
    got = url_rules.judge(pages, none).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            host, path = brute(URLS[r.page_id])
            rule, verdict = rule_of(host, path, url_rules.RULES)
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), URLS[r.page_id]
    assert url_rules.judge(pages.limit(0), none).count() == 0


def test_mined_rules_against_counts(spark):
    r = random.Random(8)
    rows = []
    for k in range(400):
        sub, word, key = r.choice(["m", "www", "blog"]), r.choice(["win", "news"]), r.choice(["ref", "page"])
        bad = word == "win" and key == "ref" and r.random() < 0.95 or r.random() < 0.03
        rows.append((k, f"http://{sub}.site{k % 5}.org/{word}/{k}?{key}=1", bad))
    rows += [(900, None, True), (901, "http://x.org/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, block boolean")
    mined = url_rules.mine_rules(pages, min_support=0.02, min_confidence=0.8, min_pages=1).collect()
    sets = [(set(t), b) for t, b in pages.select(url_rules.tokens(pages.url).alias("t"), "block").where("size(t) > 0 AND block IS NOT NULL").collect()]
    assert {"path:win", "key:ref"} in [set(m["items"]) for m in mined]
    for m in mined:
        fits = [b for t, b in sets if t >= set(m["items"])]
        assert m.support == len(fits) and abs(m.confidence - sum(fits) / len(fits)) < 1e-9
        assert m.confidence >= 0.8 and sum(fits) >= 0.02 * len(sets) and m.key in m["items"]
    assert url_rules.mine_rules(pages.limit(40)).count() == 0
    rules = spark.createDataFrame(mined, "items array<string>, confidence double, support long, key string")
    got = {x.page_id: x.verdict for x in url_rules.judge(pages, rules, rules=[]).collect()}
    for k, url, _ in rows[:400]:
        tok = next(set(t) for t, in pages.where(f"page_id = {k}").select(url_rules.tokens(pages.url)).collect()) if k < 25 else None
        if tok is not None:
            assert got[k] == ("block" if any(set(m["items"]) <= tok for m in mined) else "allow"), url
    assert got[900] == "allow"


def test_no_labels(spark):
    empty = spark.createDataFrame([], "page_id long, url string, block boolean")
    assert url_rules.mine_rules(empty).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "http://a.b/c", "x"), (2, "http://a.b/d", "x"), (3, "http://a.b/e", "x")], "page_id long, url string, html string")
    assert {(r.page_id, r.block) for r in url_rules.labelled_pages(pages, labels).collect()} == {(1, True), (2, False)}


def test_every_part_of_a_url_can_tell(spark):
    """Inner host labels, deep segments and late keys make rules, which pages are judged by."""
    urls = {
        "label": ("http://m.casino-win.example.com/a/{}", "http://m.calm.example.com/a/{}"),
        "path": ("http://a.org/1/2/3/4/bets/{}", "http://a.org/1/2/3/4/news/{}"),
        "key": ("http://a.org/?a=1&b=1&c=1&d=1&zwin={}", "http://a.org/?a=1&b=1&c=1&d=1&zzz={}"),
    }
    rows = [(u.format(k), bad == 0) for pair in urls.values() for bad, u in enumerate(pair) for k in range(30)]
    pages = spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(rows)], "page_id long, url string, block boolean")
    mined = url_rules.mine_rules(pages, min_confidence=0.99).cache()
    assert {"label:casino-win", "path:bets", "key:zwin"} <= {i for m in mined.collect() for i in m["items"] if len(m["items"]) == 1}
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, mined, rules=[]).collect()}
    assert all((got[k] == "block") == bad for k, (_, bad) in enumerate(rows))
