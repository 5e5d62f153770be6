import random

from tessera.llm import urlfilter


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:]
        path = path[:next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules
            if h is not None and p is not None and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    won = max(fits, default=(0, 0, None, default))
    return host, path, won[2], won[3]


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def check(spark, urls, rules):
    from pyspark.sql import functions as F
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "rule", "key", "_x")})
    got = urlfilter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *brute(u, rules)) for i, u in urls), key=str)


def test_cases(spark):
    urls = [None, "", "no scheme", "://", "http://", "http://Example.NET/en/x", "http://example.net/en", "http://a.b.example.net/en/?q#f",
            "http://example.net?x=/en/", "http://badexample.net/en/", "http://x.org/fr/1", "http://org/fr/", "http://example.com/de/",
            "http://example.com/DE/", "x://y://example.com/de/", "http://.net/", "http://net./", "http://a..net/", "http://user@x.net:80/",
            "http://" + "l." * 3000 + "net/" + "p" * 5000, "http://example.net/en/x"]
    check(spark, [(i if i % 5 else None, u) for i, u in enumerate(urls)] + [(3, urls[5])] * 3, RULES)
    check(spark, [(1, "http://x.net/")], [])
    check(spark, [], RULES)


def test_random_nests(spark):
    """Rules nested in hosts and in paths, over few range partitions."""
    rnd = random.Random(4)
    hosts = ["a", "b.a", "c.b.a", "c.a", "ab", "b"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/xy", "/x/y/z", "/é"]
    rules = [(rnd.choice(hosts), rnd.choice(paths), rnd.choice(["allow", "block"])) for _ in range(25)] + [(None, "/", "block")]
    blocked = {}
    for h, p, v in rules:
        blocked[h, p] = max(v, blocked.get((h, p), v))
    rules = [(h, p, v) for (h, p), v in blocked.items()]
    urls = [(i, f"http://{rnd.choice(['', 'd.', 'e.d.'])}{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', 'q', '/y', '?'])}") for i in range(400)]
    check(spark, urls, rules)
