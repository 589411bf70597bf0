import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from spanwright.llm.urlrules import Rule, judge, mine, tokens

RULES = [Rule("org", "/", False), Rule("example.org", "/es/", True), Rule("example.org", "/en/1", True), Rule("com", "/fr/", False), Rule("com", "/de/", True)]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [k for k in map(rest.find, "/?#") if k >= 0]
    host, tail = rest[: min(ends, default=len(rest))], rest[min(ends, default=len(rest)) :]
    ends = [k for k in map(tail.find, "?#") if k >= 0]
    return "".join(c.lower() if c.isascii() else c for c in host), tail[: min(ends, default=len(tail))]


def stated(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(str(r)), default=None)


def test_rules_and_odd_urls(spark):
    urls = ["http://A.Example.org/es/x?y#z", "https://example.org/en/12", "https://example.org/en/2", "http://notexample.org/es/", "http://x.com/de/1?a", "http://com/fr/", "http://mycom/fr/", "http://a.org", "http://a.org?x/", None, "", "no scheme/de/", "a://b://c.com/de/", "http://É.com/de/\n?", "x\n://q.org/", "http://-/", "://x.com/fr/..", "http://a.com/" + "s/" * 5000]
    pages = spark.createDataFrame([(k, u, "v") for k, u in enumerate(urls)] + [(3, urls[3], "v"), (None, urls[0], "v")], "page_id bigint, url string, verdict string")
    got = judge(pages, RULES).collect()
    assert len(got) == len(urls) + 2
    for g in got:
        url = urls[0] if g.page_id is None else urls[g.page_id]
        host, path = parts(url)
        rule = stated(host, path)
        assert (g.host, g.path, g.rule) == (host, path, str(rule) if rule else None), url
        if rule:
            assert g.verdict == ("block" if rule.block else "allow")
    assert judge(pages.limit(0), RULES).count() == 0


def brute(rows, support, confidence, items):
    n, bad = len(rows), sum(b for _, b in rows)
    count, hits = Counter(t for ts, _ in rows for t in ts), Counter(t for ts, b in rows for t in ts if b)
    tell = {t: (hits[t] - c * bad / n) ** 2 / c for t, c in count.items() if c >= max(1.0, support * n)}
    chosen = sorted(tell, key=lambda t: (-round(tell[t], 9), t))[:items]
    rules = {}
    for k in range(1, items + 1):
        for own in combinations(sorted(chosen), k):
            cover = [b for ts, b in rows if set(own) <= set(ts)]
            if cover and sum(cover) >= support * n and sum(cover) / len(cover) >= confidence:
                rules[frozenset(own)] = sum(cover) / len(cover)
    return {k: c for k, c in rules.items() if not any(o < k and d >= c for o, d in rules.items())}


def test_mined_rules_against_enumeration(spark):
    r = random.Random(4)
    rows = []
    for _ in range(400):
        ts = r.sample([f"t{k}" for k in range(9)], r.randint(1, 5))
        rows.append((ts, ("t1" in ts and "t2" in ts) or ("t3" in ts and r.random() < 0.85) or r.random() < 0.1))
    labelled = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    got = {frozenset(t): c for t, c, _ in mine(labelled, 0.02, 0.8, 7)}
    want = brute(rows, 0.02, 0.8, 7)
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_mined_rules_block_like_urls(spark):
    rows = [(k, f"http://h{k % 50}.{'casino-win' if k % 4 == 0 else 'news'}.net/a/{k}") for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(k, k % 4 == 0) for k in range(200)] + [(None, True), (1, None)], "page_id bigint, blocked boolean")
    got = {g.page_id: g.verdict for g in judge(pages, RULES, labels).collect()}
    assert got == {k: "block" if k % 4 == 0 else "allow" for k in range(400)}
    found = pages.select(tokens(F.lit("http://M.a-b.net/x/12/y.html?p=1&q#f")).alias("t")).first().t
    assert set(found) == {"h:m", "h:a-b", "h:net", "h:a", "h:b", "p:x", "p:#", "p:y", "e:html", "q:p", "q:q"}


def test_no_token_or_rule_is_cut(spark):
    r = random.Random(9)
    rows = [([f"good{k % 20}", f"also{k % 20}"], False) for k in range(400)] + [([f"bad{k % 25}", f"twin{k % 25}", r.choice("xyz")], r.random() < 0.95) for k in range(1000)]
    labelled = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    got = {frozenset(t): c for t, c, _ in mine(labelled, 0.005, 0.8)}
    count = {t for ts, _ in rows for t in ts}
    want = {}
    for n in range(1, 4):
        for own in {frozenset(c) for ts, _ in rows for c in combinations(sorted(ts), n)}:
            cover = [b for ts, b in rows if own <= set(ts)]
            if sum(cover) >= 0.005 * len(rows) and sum(cover) / len(cover) >= 0.8:
                want[own] = sum(cover) / len(cover)
    want = {k: c for k, c in want.items() if not any(o < k and d >= c for o, d in want.items())}
    assert len(count) > 80 and {frozenset([f"bad{k}"]) for k in range(25)} <= want.keys()
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
