import random
import re

from pyspark.sql import functions as F

from gristmill.llm import licenses as L


SETS = [(name, {tuple(b.split(" ")) for b in L.bigrams_of(text)}) for name, text in sorted(L.TEMPLATES)]


def brute(text, t):
    out = []
    units = [("line", i + 1, u) for i, u in enumerate(re.split("\r\n|[\n\r]", text or ""))]
    units += [("paragraph", i + 1, u) for i, u in enumerate(re.split(r"(?:\r\n|[\n\r])[ \t]*(?:\r\n|[\n\r])\s*", text or "")) if re.search(r"\S\s*[\n\r]\s*\S", u)]
    for kind, no, u in units:
        w = re.sub(r"[\W_]+", " ", u.lower()).split()
        g = set(zip(w, w[1:]))
        best = None
        for name, h in SETS:
            d = 2 * len(g & h) / max(1, len(g) + len(h))
            if d >= t and (best is None or d > best[1]):
                best = (name, d)
        if best:
            out.append((kind, no, *best))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(11)
    rows = [(0, None), (1, ""), (2, "word"), (3, "\n\n \r\n")]
    texts = [t for _, t in L.TEMPLATES]
    for i in range(300):
        parts = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(["license", "x", "THE", "é", "***"])
            k = rng.randint(1, 20)
            parts.append(rng.choice([" ", "  ### "]).join(w) if rng.random() < 0.5 else "\n".join(" ".join(w[j:j + k]) for j in range(0, len(w), k)))
        rows.append((10 + i, rng.choice(["\n", "\n\n", "\r\n \r\n"]).join(parts)))
    rows += [(10, rows[4][1]), (None, texts[1]), (900, "the end " * 100_000 + "\n" + texts[4]), (901, "\n" * 100_000 + texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("unit", F.lit(1)).withColumn("kind", F.lit(1)).withColumn("bigrams", F.lit(1))
    for t in (0.8, 0.5):
        got = sorted((tuple(r) for r in L.scan(docs, threshold=t).collect()), key=str)
        want = sorted(((d, *m) for d, text in rows for m in brute(text, t)), key=str)
        assert got == want and len(got) > 300
    assert L.scan(docs.limit(0)).count() == 0
    assert "Python" not in L.scan(docs)._jdf.queryExecution().toString()
