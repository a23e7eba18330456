"""URL filter against a plain reading of the rules, and its edge rows."""

import random

from evalpack.llm import url_filter

RULE = "host string, path string, verdict string"


def plain(url, rules, otherwise="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3:]
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, rest = rest[:end], rest[end:]
        path = rest[:min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules
           if None not in (h, p, v) and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[4]) if fit else (host, path, None, otherwise)


def check(spark, urls, rules, otherwise="allow"):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    out = url_filter.filter_urls(pages, spark.createDataFrame(rules, RULE), otherwise)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    got = {r.page_id: tuple(r)[1:] for r in out.collect()}
    assert got == {i: plain(u, rules, otherwise) for i, u in enumerate(urls)}


def test_random_urls_and_rules(spark):
    rng = random.Random(13)
    labels, parts = ["a", "b", "net", "x-y", "", "com:80"], ["en", "e", "", "fr", "en.html"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    path = lambda n: "".join("/" + rng.choice(parts) for _ in range(n))
    rules = [(host(rng.randint(1, 3)), path(rng.randint(0, 3)), rng.choice(["allow", "block"])) for _ in range(60)]
    urls = ["http://" + host(rng.randint(1, 4)) + path(rng.randint(0, 4)) + rng.choice(["", "?q=/en/", "#/fr", "/"])
            for _ in range(600)]
    check(spark, urls, rules)


def test_edge_rows(spark):
    rules = url_filter.RULES + [("net", "/", "block"), ("NET", "/", "allow"), ("", "", "block"), (None, "/", "block"),
                                ("example.com", "/fr", "block"), ("example.com", "", "allow")]
    urls = [None, "", "no scheme", "http:/x.net/", "http://net/", "HTTP://WWW.EXAMPLE.NET/en/1", "http://xnet/", "http://a.net",
            "http://a.net?x=/", "x://example.com/french#/de/", "a://b://c.net/d", "http://.net/", "http://É.NET/",
            "http://example.com/de/", "http://example.com/de/", "http://u@example.net:1/en/", "://", "http://a.net/\n/x"]
    check(spark, urls, rules)
    check(spark, urls, url_filter.RULES, "block")
    check(spark, urls, [])
    check(spark, [], rules)


def test_long_urls(spark):
    check(spark, ["http://" + "a." * 20000 + "net/" + "b/" * 20000, "http://" + "n" * 300000 + ".org/fr/" + "/" * 1000], url_filter.RULES)


def test_plan_is_native(spark):
    plan = url_filter.op13_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
