import random
import time

from pyspark.sql import functions as F

from gristmill.llm import url_filter


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(h.count("."), len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[3] if best else None, best[4] if best else default)


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    pick = lambda xs, a, b: [rng.choice(xs) for _ in range(rng.randint(a, b))]
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("com", "", "allow")]
    rules += [(".".join(pick(["a", "b", "org"], 1, 3)), "/" + "/".join(pick(["x", "xy", ""], 0, 3)), rng.choice(["allow", "block"])) for _ in range(40)]
    urls = [None, "", "no scheme/x", "http://", "HTTP://ORG", "http://ÄB.Org/é?x", "x://y://org/", "http://a.org:80/x", "http://.org/", "http:///x", "a\nb://example.org/es/\nq"] + ["x" * 50_000, "http://a.b/" + "x/" * 20_000]
    urls += [f"http://{'.'.join(pick(['a', 'B', 'org', 'example', 'com'], 1, 4))}{rng.choice(['', '/', '/es/', '/en/1', '/fr/q'])}{'/'.join(pick(['x', 'xy', 'xyz', ''], 0, 4))}{rng.choice(['', '?a=/x', '#/x'])}" for _ in range(800)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit(3)).withColumn("rule", F.lit(3))
    for most in (10_000, 10):
        monkeypatch.setattr(url_filter, "TRIE_CHARS", most)
        out = url_filter.judge(df, rules)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
        assert got == {i: brute(u, rules) for i, u in enumerate(urls)}
        assert sorted(out.columns) == ["host", "page_id", "path", "rule", "url", "verdict"]
    assert url_filter.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(df, []).collect()} == {"allow"}


def test_long_segments_are_tried_at_the_lengths_of_entries_only():
    trie = url_filter.Trie([("com", "/", "allow"), ("com", "/aa", "block"), ("com", "/aaaa", "allow"), ("com", "/b/", "block"), ("com", "/b/c", "allow")])
    start = time.perf_counter()
    assert trie.find("x.com", "/" + "a" * 1_000_000) == ("com/aaaa", "allow")
    assert trie.find("x.com", "/aaa" + "b" * 1_000_000) == ("com/aa", "block")
    assert trie.find("x.com", "/b/" + "d" * 1_000_000 + "/e") == ("com/b/", "block")
    assert time.perf_counter() - start < 0.5
