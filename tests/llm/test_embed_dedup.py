import numpy as np
from pyspark.sql import functions as F

from gristmill.llm import embed_dedup


def brute(rows, t=0.98):
    def vec(r):
        i, e, lab = r
        if i is None or lab is None or not e or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            return None
        x = np.array(e, float)
        x = x / np.abs(x).max()
        return x / np.linalg.norm(x)

    v, links, up = [vec(r) for r in rows], [0] * len(rows), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if v[i] is not None and v[j] is not None and rows[i][2] == rows[j][2] and len(v[i]) == len(v[j]) and v[i] @ v[j] >= t:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return sorted(((r[0], links[i], low.get(root(i)), r[0] is not None and low[root(i)] == r[0]) for i, r in enumerate(rows)), key=str)


def test_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows, n = [], 0
    for g in range(25):
        c = rng.standard_normal(16)
        for _ in range(1 + (g % 5) * 3 + (60 if g == 7 else 0)):
            x = c + rng.standard_normal(16) * 0.07 * np.linalg.norm(c) / 4
            rows.append((n, x.tolist(), g % 3))
            n += 1
    rows += [(n + i, rows[3][1], rows[3][2]) for i in range(30)] + [(900, rows[3][1], None), (901, None, 1), (902, [], 1), (903, [0.0] * 16, 1), (904, [1.0, None], 1), (905, [float("nan"), 1.0], 1)]
    rows += [(906, [float("inf"), 1.0], 1), (907, [1.0, 1.0], 1), (908, [2.0, 2.0], 1), (None, rows[0][1], 0), (0, rows[0][1], 0), (5, rows[-20][1], 2), (909, [1e300, 1e300], 1), (910, [1e-300, 1e-300], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("x")).withColumn("links", F.lit(1)).withColumn("vector", F.lit(1))
    for block in (1024, 7):
        monkeypatch.setattr(embed_dedup, "BLOCK", block)
        got = sorted(map(tuple, embed_dedup.near_duplicates(df).collect()), key=str)
        assert got == brute(rows)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_recall_with_narrow_windows(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((400, 32))
    rows = [(int(i), (base[i % 400] + rng.standard_normal(32) * 0.12).tolist(), 0) for i in range(1200)]
    want = brute(rows)
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), window=8).collect()
    assert sum(r.n_links for r in got) >= 0.98 * sum(w[1] for w in want) > 0


def test_recall_of_vectors_with_a_common_mean(spark):
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    common = unit(rng.standard_normal((1, 64)))
    base = unit(3 * common + unit(rng.standard_normal((6000, 64))))
    side = rng.standard_normal((300, 64))
    side = unit(side - (side * base[:300]).sum(axis=1, keepdims=True) * base[:300])
    cosine = rng.uniform(0.981, 0.99, (300, 1))
    x = np.vstack([base, cosine * base[:300] + np.sqrt(1 - cosine * cosine) * side])
    assert 0.85 < (base[:500] @ base[500:1000].T).mean() < 0.95
    want = (x @ x.T >= 0.98).sum(axis=1) - 1
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sum(r.n_links for r in got) >= 0.998 * want.sum() >= 500
