import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from gristmill.llm import warc

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def brute(rows):
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    tag = lambda h: h["etag"].strip().removeprefix("W/") if h.get("etag") is not None else None
    out = []
    for i, url, ts, kind, headers, _ in rows:
        if kind != "revisit":
            continue
        h, best = low(headers), None
        for j, u, t, k, hh, p in rows:
            if k == "response" and None not in (i, ts, url, j, u, t) and u.split("#")[0].lower() == url.split("#")[0].lower() and t < ts and (best is None or (t, j) > best[:2]):
                best = (t, j, low(hh), p)
        state, merged = "orphan", None
        if best:
            a, b = tag(h), tag(best[2])
            c, d = h.get("last-modified"), best[2].get("last-modified")
            state = ("resolved" if a == b else "stale") if a is not None and b is not None else ("resolved" if c == d else "stale") if c is not None and d is not None else "unverified"
            if state == "resolved":
                merged = best[2] | {k: v for k, v in h.items() if k in warc.PERMITTED and v is not None}
        out.append((i, state, best[1] if best else None, merged, best[3] if state == "resolved" else None))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(500):
        url = "http://hot.example.com/x" if rng.random() < 0.5 else f"http://{rng.choice('aB')}.example.com/{rng.randint(0, 5)}{rng.choice(['', '#q'])}"
        headers = {rng.choice(["ETag", "etag"]): rng.choice(['"1"', 'W/"1"', '"2"', None]), "Last-Modified": rng.choice(["a", "b", None]), "Content-Length": str(i), "Expires": rng.choice(["e", None])}
        headers = {k: v for k, v in headers.items() if v is not None or rng.random() < 0.3} if rng.random() < 0.9 else None
        kind = rng.choice(["response", "revisit", "request"])
        rows.append((i, url if i % 41 else None, T0 + timedelta(minutes=rng.randint(0, 4000)) if i % 43 else None, kind, headers, f"body {i}" if kind == "response" else None))
    rows += [(None, "http://hot.example.com/x", T0, "revisit", None, None), rows[10], rows[11]]
    rows = [r if r[3] != "response" or r[0] is None else r for r in rows]
    df = spark.createDataFrame(rows, "record_id long, url string, ts timestamp, kind string, headers map<string,string>, payload string").withColumn("h", F.lit(1)).withColumn("state", F.lit(1)).withColumn("_chunk", F.lit(1))
    for seconds in (warc.CHUNK_SECONDS, 120):
        out = warc.with_payload(warc.resolve(df, seconds), df)
        got = sorted(((r.record_id, r.state, r.refers_to, r.headers, r.payload) for r in out.collect()), key=lambda x: str((*x[:3],)))
        want = sorted(brute([tuple(r) for r in df.select("record_id", "url", "ts", "kind", "headers", "payload").collect()]), key=lambda x: str((*x[:3],)))
        assert [(*g[:3], g[4]) for g in got] == [(*w[:3], w[4]) for w in want]
        assert [g[3] for g in got] == [w[3] for w in want]
    assert warc.resolve(df.limit(0)).count() == 0


def test_canonical(spark):
    urls = ["HTTP://www.Example.com:80/a/?b=2&a=1&utm_source=x#f", "https://example.com/a?a=1&b=2", "example.com/a/?a=1&b=2&ref=z", None, "", "http://u:p@x.org/é?"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.canonical_url(F.col("u"))).collect()]
    assert got == ["example.com/a?a=1&b=2"] * 3 + [None, "", "x.org/é"]


def test_only_full_responses_are_referred_to(spark):
    tag = {"ETag": '"1"'}
    other = {"ETag": '"2"'}
    rows = [(1, "http://a.com/x", T0, "response", 200, tag, "whole"), (9, "http://a.com/x", T0 + timedelta(hours=9), "revisit", 304, tag, None)]
    rows += [(i + 2, "http://a.com/x", T0 + timedelta(hours=i + 1), "response", status, tag if status == 206 else other, "part") for i, status in enumerate((404, 301, 304, 503, 206))]
    rows += [(20, "http://b.com/x", T0, "response", None, tag, "unknown"), (21, "http://b.com/x", T0 + timedelta(hours=1), "revisit", 304, tag, None)]
    rows += [(30, "http://c.com/x", T0, "response", 206, tag, "part"), (31, "http://c.com/x", T0 + timedelta(hours=1), "revisit", 304, tag, None)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts timestamp, kind string, status int, headers map<string,string>, payload string")
    for records in (df, df.withColumn("status", F.col("status").cast("string"))):
        for seconds in (warc.CHUNK_SECONDS, 120):
            got = {r.record_id: (r.state, r.refers_to, r.payload) for r in warc.with_payload(warc.resolve(records, seconds), records).collect()}
            assert got == {9: ("resolved", 1, "whole"), 21: ("resolved", 20, "unknown"), 31: ("orphan", None, None)}
