import random

from kinweave.llm import url_filter
from kinweave.llm.queries import URL_RULES


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), -len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rules_from(spark, rules)).collect()}
    assert found == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_contract_rules(spark):
    check(spark, [None, "", "no scheme", "http://", "https://EXAMPLE.net/en/1?x#y", "http://a.example.com/de/", "http://a.example.com/des", "http://xexample.com/de/", "http://b.org/fr/2#t", "http://net/", "http://c.net", "http://c.net?q=/", "ftp://é.org/fr/", "http://example.net/en", "a://b://c.net/x"], URL_RULES)


def test_many_nested_rules(spark):
    rng = random.Random(4)
    labels = ["a", "b", "c", "a-b", "ab"]
    rules = sorted({(".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5))), rng.choice(["/", "/x/", "/x/y/", "/xy"])) for _ in range(120)})
    rules = [(h, p, rng.choice(["block", "allow"])) for h, p in rules]
    urls = ["http://" + ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 6))) + rng.choice(["", "/", "/x/1", "/x/y/2", "/xyz", "?x"]) for _ in range(500)]
    check(spark, urls + urls[:50], rules)


def test_odd_pages(spark):
    pages = spark.createDataFrame([(None, "http://a.net/x"), (None, "http://a.net/x"), (3, "http://a.net/" + "y" * 50000), (4, "http://" + "a." * 3000 + "net/")], "page_id bigint, url string")
    found = url_filter.judge_urls(pages, url_filter.rules_from(spark, [*URL_RULES, ("net", "/y", "allow")])).collect()
    assert sorted((r.page_id or 0, r.rule) for r in found) == [(0, "net/"), (0, "net/"), (3, "net/y"), (4, "net/")]


def test_no_pages_and_no_rules(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    rules = url_filter.rules_from(spark, URL_RULES)
    assert url_filter.judge_urls(none, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/x", 5, 6, 7)], "page_id bigint, url string, host int, active int, key int")
    assert [r.verdict for r in url_filter.judge_urls(one, rules.where("false")).collect()] == ["allow"]
    assert [r.verdict for r in url_filter.judge_urls(one, rules).collect()] == ["block"]
