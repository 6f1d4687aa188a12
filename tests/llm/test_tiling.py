import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from gristmill.llm import tiling


def brute_covered(doc, item, k):
    """Words of ``item`` covered by greedy string tiling, by comparing all places again for every tile."""
    used_d, used_i, total = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for b in range(len(item)):
            for a in range(len(doc)):
                n = 0
                while b + n < len(item) and a + n < len(doc) and doc[a + n] == item[b + n] and not used_d[a + n] and not used_i[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < k:
            return total
        for x in range(n):
            used_d[a + x] = used_i[b + x] = True
        total += n


def test_tiles_equal_brute_force():
    rng = random.Random(3)
    for trial in range(150):
        letters = "ab" if trial % 3 else "abcdefghijkl"
        item = [rng.choice(letters) for _ in range(rng.randint(1, 30))]
        doc = [rng.choice(letters) for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):
            at, n = rng.randrange(len(item)), rng.randint(1, 12)
            doc[rng.randint(0, len(doc)):0] = item[at:at + n]
        seeds = tiling.Seeds([(1, " ".join(item))], 3)
        words, _ = tiling.words_of([" ".join(doc)])
        got = {m[0]: m[3] for m in tiling.matches(seeds, words, 1e-9)}
        assert got.get(1, 0) == brute_covered(doc, item, 3)


def test_documents(spark, monkeypatch):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n))
    item = prose(60)
    w = item.split(" ")
    moved = " ".join(w[40:] + w[20:40] + w[:20])
    docs = [
        (1, prose(300) + " " + item + " " + prose(200)), (2, prose(50) + "\n" + moved.upper() + ".\n" + prose(20)), (3, prose(400)), (4, None), (5, ""),
        (6, " ".join(w[:20]) + " " + prose(10)), (7, " ".join(w[:20]) + ". " + prose(3) + " " + " ".join(w[30:50])), (1, item), (None, item), (8, (prose(1) + " ") * 50_000 + item)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("coverage", F.lit(None).cast("int"))
    b = spark.createDataFrame([(10, item), (11, "one two"), (12, None), (13, ""), (14, prose(30))], "item_id long, text string").withColumn("doc_id", F.lit(9))
    for chars in (10_000, 100):
        monkeypatch.setattr(tiling, "BLOCK_CHARS", chars)
        got = sorted(map(tuple, tiling.contaminated(d, b).select("doc_id", "item_id", "covered", "tiles").collect()), key=str)
        assert got == sorted([(1, 10, 60, 1), (1, 10, 60, 1), (2, 10, 60, 3), (7, 10, 40, 2), (8, 10, 60, 1), (None, 10, 60, 1)], key=str)
        rest = tiling.decontaminate(d, b)
        assert rest.columns == d.columns and sorted(r.doc_id for r in rest.collect()) == [3, 4, 5, 6]
    assert tiling.contaminated(d.limit(0), b).count() == 0 and tiling.decontaminate(d, b.limit(0)).count() == len(docs)
    assert np.isclose(tiling.contaminated(d, b).agg(F.min("coverage")).first()[0], 40 / 60)


def test_long_repetitive_documents_take_bounded_memory():
    item = "one two three four five " * 200
    seeds = tiling.Seeds([(1, item)], 5)
    words, _ = tiling.words_of([item * 1000])
    tracemalloc.start()
    assert list(tiling.matches(seeds, words, 0.6)) == [(1, 1000, 1, 1000)]
    # all pairs of places would be 200 million
    assert len(words) == 1_000_000 and tracemalloc.get_traced_memory()[1] < 700 << 20
    tracemalloc.stop()
    rng = random.Random(7)
    letters = " ".join(rng.choice("ab") for _ in range(400))
    found = list(tiling.matches(tiling.Seeds([(1, letters)], 5), tiling.words_of([" ".join(rng.choice("ab") for _ in range(60_000))])[0], 0.6))
    assert found[0][3] > 380


def test_classes_of_length_give_the_tiles_of_a_global_search():
    rng = random.Random(8)
    for _ in range(60):
        item = [rng.choice("abc") for _ in range(rng.randint(20, 60))]
        doc = []
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(item))
            doc += item[at:at + rng.randint(1, 40)] + [rng.choice("abcd") for _ in range(rng.randint(0, 4))]
        a, b = tiling.words_of([" ".join(doc)])[0], tiling.words_of([" ".join(item)])[0]
        tiles = tiling.tile(a, b, 3)
        assert sum(t[0] for t in tiles) == brute_covered(doc, item, 3)
        assert [t[0] for t in tiles] == sorted((t[0] for t in tiles), reverse=True)
