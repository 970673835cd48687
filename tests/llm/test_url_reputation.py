import math
import random
from collections import Counter

from logsift.llm.url_reputation import RULES, judge_urls


def brute(rows):
    split, labels = [], Counter()
    for page, url in rows:
        rest = url.partition("://")[2] if url else ""
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
        fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rule = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        split.append((page, host, path, rule))
        if rule:
            labels[host, rule[0] == "block"] += 1

    def level(host, n):
        return ".".join(host.split(".")[-n:]) if n else ""

    def counts(name, n):
        got = [(b, c) for (h, b), c in labels.items() if (h if n is None else level(h, n)) == name or n == 0]
        return sum(c for b, c in got if b), sum(c for _, c in got)

    out = []
    for page, host, path, rule in split:
        mean, weight = 0.5, 0
        for name, n in (("", 0), (level(host, 1), 1), (level(host, 2), 2), (host, None)):
            bad, total = counts(name, n)
            if n == 0 or total:
                mean, weight = (bad + 10 * mean) / (total + 10), total
        low = mean - math.sqrt(mean * (1 - mean) / (weight + 11))
        out.append((page, host, path, rule and rule[1] + rule[2], rule[0] if rule else ("allow", "block")[low > 0.5]))
    return sorted(out, key=str)


def test_verdicts_match_brute_force(spark):
    rnd = random.Random(1)
    hosts = ["Example.com", "www.example.com", "a.example.com", "x.net", "m.x.net", "y.net", "z.org", "net", "example.com:80",
             "badexample.com", "q.co.net", "", "one"]
    rows = [(i, f"http://{rnd.choice(hosts)}{rnd.choice(['/en/a', '/es/b?x=/en/', '/fr/', '', '?q', '#/en/', '/de/', '//en/'])}") for i in range(400)]
    rows += [(i + 1000, "https://only.net/es/") for i in range(100)] + [(i + 1200, "https://only.net/de/") for i in range(20)]
    rows += [(2000, None), (2001, "nothing"), (None, "ftp://a.b/://c"), (2002, ""), (3, rows[3][1]), (2003, "http://h/" + "a" * 100_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, host int").repartition(4)
    got = judge_urls(pages)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=str) == brute(rows)
    assert any(r.rule is None and r.verdict == "block" for r in got.collect())
    assert judge_urls(pages.limit(0)).count() == 0


def test_given_outcomes_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://bad.x.org/"), (2, "http://new.x.org/"), (3, "http://good.y.org/"), (4, "http://n.com/")],
                                  "page_id long, url string")
    outcomes = spark.createDataFrame([("bad.x.org", 90, 90), ("good.y.org", 0, 90)], "host string, bad long, n long")
    said = {r.page_id: r.verdict for r in judge_urls(pages, rules=(), outcomes=outcomes).collect()}
    assert said == {1: "block", 2: "block", 3: "allow", 4: "allow"}
