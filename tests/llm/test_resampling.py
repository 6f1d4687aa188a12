import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from gristmill.llm import queries, resampling


def runs_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(" ".join(words[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, benchmark):
    raw, target = Counter(b for _, t in docs for b in runs_of(t)[1]), Counter(b for _, t in benchmark for b in runs_of(t)[1])
    s, t = sum(raw.values()), sum(target.values())
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (s + 10_000) / ((raw[b] + 1) * (t + 10_000))))
    rows = []
    for doc_id, text in docs:
        words, buckets = runs_of(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, buckets))
        rows.append([doc_id, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(able[:5 * len(able) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in rows]


def texts(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéÉZ9") for _ in range(rng.randint(1, 3)))
    return [" ".join(word() + rng.choice(["", ",", "\n", "\x00", "　"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def order(rows):
    return sorted(rows, key=str)


def test_query_equals_brute_force(spark, tmp_path):
    docs = [(i * 7 % 900, t) for i, t in enumerate(texts(900))] + [(900, None), (901, ""), (902, "Ab " * 30_000), (-5, "neu " * 25)]
    benchmark = list(enumerate(texts(40, 2))) + [(40, None)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op11_importance_resampling(spark, str(tmp_path)).collect()
    assert order(map(tuple, got)) == order(brute(docs, benchmark))


def test_ties_nulls_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(resampling, "DIGIT_BITS", 3)
    monkeypatch.setattr(resampling, "BLOCK_ROWS", 7)
    docs = [(i, "same words " * 12) for i in (5, 3, 2**62, -(2**62), 0, None, 3)] + [(i, "short") for i in (1, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("_at", F.lit(1)).withColumn("weight", F.lit(None).cast("int"))
    target = spark.createDataFrame([("same words",)], "text string")
    got = [tuple(r) for r in resampling.resample(frame, target, share=1.0).collect()]
    ranked = sorted((r for r in got if r[4]), key=lambda r: r[4])
    assert [r[4] for r in ranked] == list(range(1, 8)) and len(got) == 9
    assert [r[:4] for r in ranked] == [r[:4] for r in sorted(ranked, key=lambda r: (-r[3], r[0] is None, r[0] or 0))]
    assert resampling.resample(frame.limit(0), target).count() == 0
    assert resampling.resample(frame, target.limit(0)).count() == 9


def test_radix_order_of_any_longs(spark, monkeypatch):
    """Many equal keys over several blocks, digits of several widths, keys of all sizes."""
    rng = random.Random(6)
    rows = [(rng.choice([0, 1, 7, 2**40, 2**63 - 1, rng.getrandbits(63)]), rng.randrange(4), i) for i in range(600)]
    frame = resampling.cut(spark.createDataFrame(rows, "a long, b long, c long").repartition(6))
    for bits, block in ((16, 1 << 18), (5, 16), (1, 64)):
        monkeypatch.setattr(resampling, "DIGIT_BITS", bits)
        monkeypatch.setattr(resampling, "BLOCK_ROWS", block)
        keys = [F.col("b"), F.col("a")] if bits == 1 else [F.col("a"), F.col("b")]
        some = frame.withColumn("a", F.col("a") % 8) if bits == 1 else frame
        got = sorted(map(tuple, resampling.radix_ranked(resampling.cut(some), keys).collect()), key=lambda r: r[3])
        key = (lambda r: (r[1], r[0])) if bits == 1 else (lambda r: (r[0], r[1]))
        assert [r[3] for r in got] == list(range(1, 601)) and [key(r) for r in got] == sorted(map(key, got))
