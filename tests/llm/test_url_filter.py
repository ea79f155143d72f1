"""The automaton against regular expressions, and the rules."""

import random
import re

from pyspark.sql import functions as F

from fathomline.llm import url_filter


def test_automaton_equals_regular_expressions():
    rng = random.Random(9)
    globs = ["".join(rng.choice("ab*?") for _ in range(rng.randrange(0, 7))) for _ in range(60)]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))).encode() for _ in range(300)]
    found = url_filter.Automaton.of(globs).matches(texts)
    for k, glob in enumerate(globs):
        pattern = re.compile("".join(".*" if c == "*" else "." if c == "?" else c for c in glob).encode(), re.S)
        assert [bool(x) for x in found[:, k]] == [pattern.fullmatch(t) is not None for t in texts], glob


URLS = {
    "http://A.Example.net/en/x?q": ("a.example.net", "/en/x", "example.net/en/", "allow"),
    "https://example.net/de/": ("example.net", "/de/", "net/", "block"),
    "https://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
    "https://example.com/de/a#b": ("example.com", "/de/a", "example.com/de/", "block"),
    "https://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"),
    "https://x.org/fr": ("x.org", "/fr", None, "allow"),
    "https://a.net?x=/": ("a.net", "", None, "allow"),
    "https://shop.io/casino": ("shop.io", "/casino", None, "block"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "x://" + "h" * 50_000 + "/p": ("h" * 50_000, "/p", None, "allow"),
}


def test_rules_and_edges(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("html", F.lit(None).cast("string"))
    out = {r[0]: tuple(r[1:]) for r in url_filter.judge_urls(pages).collect()}
    assert out == dict(enumerate(URLS.values()))
    assert url_filter.judge_urls(pages.limit(0)).count() == 0 and url_filter.judge_urls(pages.union(pages)).count() == 2 * len(URLS)


#: Paths with a segment that ends in a rule's host.
CROSSING = {
    "http://example.com/go.net/x": ("example.com", "/go.net/x", None, "allow"),
    "http://shop.io/casino/a.example.net/en/": ("shop.io", "/casino/a.example.net/en/", None, "block"),
    "http:///foo.net/x": ("", "/foo.net/x", None, "allow"),
    "http://a.net/b.example.net/en/": ("a.net", "/b.example.net/en/", "net/", "block"),
    "http://x.org/fr/a.net/": ("x.org", "/fr/a.net/", "org/fr/", "allow"),
}


def test_host_rules_end_with_the_host(spark):
    pages = spark.createDataFrame(list(enumerate(CROSSING)), "page_id long, url string")
    assert {r[0]: tuple(r[1:]) for r in url_filter.judge_urls(pages).collect()} == dict(enumerate(CROSSING.values()))


def test_rules_equal_suffix_and_prefix(spark):
    """Random urls against plain code; a rule's host never starts in the path, and long urls are read like short ones."""
    rng = random.Random(5)
    rules = [("block", "net", "/"), ("allow", "a.net", "/en/"), ("block", "b.com", "/x"), ("allow", "org", "/fr/"), ("block", "c.b.com", "/x/y")]
    parts, urls = ["a", "b", "c", "net", "com", "org", "en", "fr", "x", "y", "a.net", "b.com"], []
    for k in range(600):
        host = ".".join(rng.choice(parts) for _ in range(rng.randrange(0, 4)))
        path = "".join("/" + rng.choice(parts) for _ in range(rng.randrange(0, 5))) + rng.choice(["", "/"])
        urls.append(f"http://{host}{path}" + "/long" * (2000 * (k % 150 == 0)))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r.page_id: r for r in url_filter.judge_urls(pages, rules, ["*y/c*"]).collect()}
    for k, url in enumerate(urls):
        host, path = url_filter.host_and_path(url)
        fits = [(v, h + p) for v, h, p in rules if f".{host}".endswith(f".{h}") and path.startswith(p)]
        verdict, rule = max(fits, key=lambda f: len(f[1]), default=("block" if "y/c" in path else "allow", None))
        assert (out[k].rule, out[k].verdict) == (rule, verdict), url
