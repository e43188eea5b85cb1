"""URL rules against plain Python, and the models' held-out accuracy."""

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import urlfilter
from tidemark.llm.queries import RULES

SCHEMA = "page_id long, url string, host string, rule int"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:at], rest[at:]
    end = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return (best.host + best.path, best.verdict) if best else (None, None)


def corpus():
    rng = random.Random(8)
    hosts = ["a.com", "COM", "x.example.com", "example.com", "notexample.com", "example.net", "b.net", "z.org", "É.org", "10.0.0.1:80", ""]
    paths = ["", "/", "/en/", "/en/7", "/en/70", "/en", "/de/8", "/de/9", "/es/", "/EN/7", "/x/en/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#f', '?a://b'])}" for _ in range(300)]
    return [(i, u) for i, u in enumerate([*urls, None, "", "no scheme", "://", "a://b://c/d", "http://x\n.com/en/\n7", "x" * 5000])] + [(0, urls[0]), (None, "https://a.com/en/")]


def test_parts_and_rules(spark):
    pages = corpus()
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], SCHEMA).repartition(3)
    got = urlfilter.judge(df, RULES).collect()
    want = []
    for key, url in pages:
        host, path = parts(url)
        want.append((key, host, path, rule(host, path)[0]))
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        _, said = rule(r["host"], r["path"])
        assert r["verdict"] in ("allow", "block") and (said is None or r["verdict"] == said)


def test_rules_are_those_of_the_contract(spark):
    """The list is written out here, with each rule's word; folders that only the longest of two rules decides."""
    assert [tuple(r) for r in RULES] == [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    want = {"http://a.com/en/1": ("com/en/", "block"), "http://x.example.com/en/70": ("example.com/en/7", "allow"), "http://b.net/de/1": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"), "https://a.EXAMPLE.net/de/8?q": ("example.net/de/8", "block"), "http://z.org/es/": ("org/es/", "block")}
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    assert [(r["rule"], r["verdict"]) for r in urlfilter.judge(pages, RULES).orderBy("page_id").collect()] == list(want.values())


def plain_models(urls, order):
    """A probability function of (context, symbol) by Witten-Bell smoothing, from nested counts."""
    after = defaultdict(Counter)
    for symbols in urls:
        for i in range(order, len(symbols)):
            for k in range(order + 1):
                after[symbols[i - k : i]][symbols[i]] += 1

    def p(context, x, v):
        seen = after[context]
        n, d = sum(seen.values()), len(seen)
        lower = p(context[1:], x, v) if context else 1 / v
        return (seen[x] + d * lower) / (n + d) if n else lower

    return p


def test_scores_are_those_of_plain_models(spark):
    rng = random.Random(10)
    pages = corpus() + [(1000 + i, f"https://{rng.choice(['win', 'big', 'play'])}-casino{i % 7}.info/{rng.randrange(99)}") for i in range(40)]
    pages += [(2000 + i, f"https://h{i}.info/a/{rng.randrange(99)}") for i in range(60)]
    rows = urlfilter.scored(spark.createDataFrame(pages, "page_id long, url string"), RULES)
    got = rows.collect()
    symbols = {u: "\x02" * urlfilter.ORDER + re.sub(r"(?s)^.*?://", "", u or "") + "\x03" for _, u in pages}
    said = {u: rule(*parts(u))[1] for _, u in pages}
    bad = {u: said[u] is None and bool(re.search(urlfilter.REJECTED_SEEDS, u or "")) for u in said}
    kind = {u: bad[u] if bad[u] or said[u] != "block" else None for u in said}
    held = {r["host"]: r["held"] for r in got}
    v = len({x for s in symbols.values() for x in s[urlfilter.ORDER :]}) + 1
    model = {(k, b): plain_models([symbols[u] for _, u in pages if kind[u] == b and not (k and held[parts(u)[0]])], urlfilter.ORDER) for k in (True, False) for b in (True, False)}

    def score(s, k):
        places = range(urlfilter.ORDER, len(s))
        return sum(math.log(model[k, True](s[i - urlfilter.ORDER : i], s[i], v) / model[k, False](s[i - urlfilter.ORDER : i], s[i], v)) for i in places) / len(places)

    want = sorted((str(i), *parts(u), round(score(symbols[u], True), 6), round(score(symbols[u], False), 6)) for i, u in pages if len(u or "") < 1000)
    assert sorted((str(r["id"]), r["host"], r["path"], round(r["held_score"], 6), round(r["score"], 6)) for r in got if len(r["path"]) < 1000 and r["id"] != 306) == [w for w in want if w[0] != "306"]
    limit = urlfilter.threshold(rows)
    accepted = sorted(r["held_score"] for r in got if r["held"] and r["accepted"])
    assert limit == max(0.0, accepted[math.ceil((1 - urlfilter.MAX_LOSS) * len(accepted)) - 1])
    for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string"), RULES).collect():
        assert rule(r["host"], r["path"])[1] or r["verdict"] == ("block" if r["score"] > limit else "allow")


def test_models_find_what_looks_like_the_rejected(spark):
    """Hosts are held out: none of a held-out host's URLs was counted, and of the look-alikes none has a seed word."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    clean = [f"https://{word(6)}.example.info/{word(5)}/{i}" for i in range(1500)]
    bad = [f"http://best-{rng.choice(['casino', 'poker', 'viagra'])}-{i}.xyz/win/{word(3)}" for i in range(300)]
    like = [f"http://best-cas1no{i}.xyz/win/{word(3)}" for i in range(40)]
    pages = spark.createDataFrame(list(enumerate(clean + bad + like)), "page_id long, url string")
    rows = urlfilter.scored(pages.where("page_id < 1800"), [])
    report = {r["rejected"]: r for r in urlfilter.held_out_report(rows, urlfilter.threshold(rows)).collect()}
    assert report[True]["blocked"] >= 0.95 * report[True]["n"] > 20 and report[False]["blocked"] <= 0.02 * report[False]["n"]
    labels = F.col("page_id") >= 1500  # the look-alikes are marked by the caller, without a word
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, [], rejected=labels).collect()}
    assert sum(got[i] == "block" for i in range(1500)) <= 15
    assert sum(got[1500 + i] == "block" for i in range(300)) >= 285 and sum(got[1800 + i] == "block" for i in range(40)) >= 38


def test_rules_do_not_hide_rejected_hosts(spark):
    """Half of the URLs are blocked by a rule; rejected hosts of no rule are few. Look-alikes without a label are examples of
    the accepted, and are only found once the caller marks them."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choices("aeinorst", k=n))
    sites = [f"{word(6)}-site" for _ in range(150)]
    ruled = [f"https://{rng.choice(sites)}.com/en/{i}" for i in range(1500)]
    clean = [f"https://{rng.choice(sites)}.com/{rng.choice(['de', 'fr'])}/{i}" for i in range(1500)]
    bad = [f"https://{word(3)}.{rng.choice(['casino', 'pills', 'poker'])}-{rng.choice(['win', 'x'])}.com/fr/{i}" for i in range(45)]
    like = [f"https://{word(3)}.casin0-win.com/fr/{i}" for i in range(10)]
    pages = spark.createDataFrame(list(enumerate(ruled + clean + bad + like)), "page_id long, url string")
    rows = urlfilter.scored(pages, RULES)
    limit = urlfilter.threshold(rows)
    report = {r["rejected"]: r for r in urlfilter.held_out_report(rows, limit).collect()}
    assert report[True]["blocked"] >= 0.9 * report[True]["n"] > 4 and report[False]["blocked"] <= 0.02 * report[False]["n"]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(pages, RULES).collect()}
    assert all(got[i] == ("com/en/", "block") for i in range(1500))
    assert sum(got[i][1] == "block" for i in range(1500, 3000)) <= 15
    assert sum(got[i][1] == "block" for i in range(3000, 3045)) >= 43
    labels = F.col("page_id") >= 3000
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, RULES, rejected=labels).collect()}
    assert sum(got[i] == "block" for i in range(3045, 3055)) >= 9 and sum(got[i] == "block" for i in range(1500, 3000)) <= 15


def test_nothing_is_rejected_without_an_example(spark):
    pages = spark.createDataFrame([(i, f"https://h{i}.info/{i}") for i in range(50)] + [(50, "https://x.com/en/")], "page_id long, url string")
    assert [r["page_id"] for r in urlfilter.judge(pages, RULES).where("verdict = 'block'").collect()] == [50]


def test_empty_table(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), RULES).collect() == []
