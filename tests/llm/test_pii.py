import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gristmill.llm import pii
from gristmill.llm.queries import pii_digest

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]():
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def texts():
    rng = random.Random(6)
    parts = ["a.b+c@mail-1.example.com", "x@y", "@", "é@", "10.0.0.255", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.002.0003.4", "4736962573099581", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (017) 555-7713",
             "+49", "+1.2", "12", "3", " ", "\n", ".", "-", "\U0001f600", "word", "_x@y.zz", "tel", "call me (555) 123-4567", "bob (at) mail (dot) com", "123-45-6789", "order no 555-123-4567", "0" * 30]
    return [None, "", "\n"] + ["".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(1, 12))) for _ in range(400)]


def test_base_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    long = "call +1 (017) 555-7713 or a@b.cc " * 3000
    rows += [(9000, long), (9001, "a" * 300_000), (9002, "1" * 200_000), (9003, "1 " * 100_000), (9004, "a@b.c." * 20_000), (None, "x@y.zz"), (5, "x@y.zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("base", F.lit(1)).withColumn("m", F.lit(1)).withColumn("_candidates", F.lit(1))
    got = pii_digest(docs).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([] if i in (9001, 9002) else brute(t))  # plain patterns take quadratic time on these two
    for r in got:
        mine = [w for w in want[r.doc_id] if ",".join(f"{k}:{s}:{e}" for s, _, e, k in w) == r.base_text]
        assert mine and r.base_sha256 == hashlib.sha256(r.base_text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in mine[0]) for k in BASE]
        assert set(filter(None, r.base_text.split(","))) <= set(filter(None, r.spans.split(",")))
    assert pii_digest(docs.limit(0)).count() == 0 and {r.spans for r in pii_digest(docs.filter("text = ''")).collect()} == {""}


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_scan(spark, n):
    rng = random.Random(n)
    xs = [rng.randint(0, 9) for _ in range(n)]
    row = spark.createDataFrame([(xs,)], "x array<bigint>").select(pii.scan(F.col("x"), lambda a, b: a + b).alias("s"), pii.scan(F.col("x"), lambda a, b: F.greatest(a, b)).alias("m")).first()
    assert row.s == [sum(xs[:i]) for i in range(n)] and row.m == [max(xs[:i], default=0) for i in range(n)]


def test_looser_spans_are_added_where_the_context_agrees(spark):
    rows = [(i, f"Please call {200 + i}-555-01{i % 90 + 10} today, or mail joe{i}@mail.example.com now.") for i in range(200)]
    rows += [(1000 + i, f"The order no {300 + i}-555-01{i % 90 + 10}x and version {i}.{i}.300.4 of it.") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii_digest(docs).collect()}
    assert all("phone:12:24" in got[i].spans for i in range(200)) and all(got[1000 + i].spans == "" for i in range(200))


def test_masked(spark):
    docs = spark.createDataFrame([(1, "mail a@1.2.3.4 or +1 (017) 555-7713, né@ x@y.zz"), (2, "nothing"), (3, None), (4, "é x@y.zz")], "doc_id long, text string")
    out = pii.decide(pii.candidates(docs), {}).select("doc_id", pii.masked(F.col("text"), F.col("spans")).alias("t"))
    assert {r.doc_id: r.t for r in out.collect()} == {1: "mail [EMAIL] or [PHONE], né@ [EMAIL]", 2: "nothing", 3: None, 4: "é [EMAIL]"}
