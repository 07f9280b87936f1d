import random

import pytest

from tessera.llm import url_filter

URLS = [None, "", "no scheme", "http://", "http://A.Example.NET/en/x?y#z", "https://example.com/de/", "https://example.com/de", "http://x.net", "http://x.net/", "http://net/", "ftp://u:p@a.org:80/fr/é", "http://evilnet/", "http://a.com?x=/en/", "http://a.net#/en/", "x://a://b.net/en/", "http://example.net/en/" + "a/" * 5000, "http://" + "a." * 2000 + "net/"]


def brute(url, rules, default="allow"):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0] if not rest[end : end + 1] in ("?", "#") else ""
    best = None
    for verdict, rule in rules:
        rhost, _, rest = rule.partition("/")
        rpath = "/" + rest if "/" in rule else ""
        if (host == rhost or host.endswith("." + rhost)) and path.startswith(rpath):
            best = max(best or (0,), (len(rule), len(rhost), rule, verdict))
    return host, path, best and best[2], best[3] if best else default


@pytest.mark.parametrize("most", [url_filter.MAX_DIGEST_BYTES, 0])
def test_judged(spark, most):
    """With no bytes allowed, the rules are joined."""
    r = random.Random(2)
    rules = [*url_filter.RULES, ("block", "a.b.c"), ("allow", "b.c/x"), ("block", "c/x/y")]
    urls = URLS + [f"http://{'.'.join(r.choices('abc', k=r.randint(1, 4)))}{r.choice(['', '/', '/x', '/x/', '/x/y', '/y'])}{r.choice(['', '?q', '#x'])}" for _ in range(200)]
    rows = [(k, u, "other") for k, u in enumerate(urls)] + [(0, URLS[4], "again"), (0, URLS[4], "again"), (None, URLS[4], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted((tuple(x) for x in url_filter.judged(pages, rules, max_bytes=most).collect()), key=str)
    assert got == sorted(((k, *brute(u, rules)) for k, u, _ in rows), key=str)
    assert url_filter.judged(pages.limit(0), rules, max_bytes=most).count() == 0


def test_equal_keys_are_told_apart_by_their_strings(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda x: len(x))
    digest = url_filter.Digest([("block", "aa/"), ("allow", "bb/"), ("block", "c/")])
    assert url_filter.probe(digest, ["bb", "aa", "dd", "x.c"], ["/", "/", "/", "/p"]) == (["bb/", "aa/", None, "c/"], ["allow", "block", None, "block"])


def test_no_rules():
    assert url_filter.probe(url_filter.Digest([]), ["a.b"], ["/"]) == ([None], [None])


@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_the_later_pair_wins_at_any_size(spark, max_bytes):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.net/x")], "page_id long, url string")
    rules = [("block", "a.net/"), ("allow", "b.net/"), ("allow", "a.net/"), ("block", "b.net/")]
    assert {r.page_id: r.verdict for r in url_filter.judged(pages, rules, max_bytes=max_bytes).collect()} == {1: "allow", 2: "block"}
