import random
from itertools import combinations

from pyspark.sql import functions as F

from gristmill.llm import ngram_join
from gristmill.llm.common import components


def brute(rows, n=5, t=0.8):
    sets = []
    for _, text in rows:
        w = [x for x in (text or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    links, up = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            a, b = sorted((root(i), root(j)))
            up[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None and (least.get(r) is None or d < least[r]):
            least[r] = d
        least.setdefault(r, None)
    return sorted(((d, least[root(i)], links[i]) for i, (d, _) in enumerate(rows)), key=str)


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "One TWO"), (5, "one two three"), (None, "one two"), (6, "x " * 5000), (7, "x " * 6000)]
    for g in range(12):
        base = [word() for _ in range(rng.randint(5, 120))]
        for k in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(k % 4):
                copy[rng.randrange(len(copy))] = word()
            rows.append((100 + g * 10 + k, " ".join(copy)))
    rows += [(100, rows[9][1]), (100, rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("family", F.lit("x")).withColumn("links", F.lit(None).cast("int"))
    for cells in (1_000_000, 3):
        monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", cells)
        got = sorted(map(tuple, ngram_join.near_duplicates(docs, recall=0.9999).collect()), key=str)
        assert got == brute(rows)
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_classes_without_ids_and_repeated_ids_keep_their_links(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120)]

    def near(k):
        return " ".join(base[:k] + ["zz"] + base[k + 1:])

    far = " ".join("".join(rng.choice("mnop") for _ in range(5)) for _ in range(60))
    rows = [(7, " ".join(base)), (None, near(3)), (None, near(110)), (None, far), (None, far + " y"), (5, near(50)), (5, near(60)), (5, far + " x"), (9, "other words here"), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x"))
    assert sorted(map(tuple, ngram_join.near_duplicates(docs, recall=0.99999).collect()), key=str) == brute(rows)
    kept = ngram_join.first_of_each(docs, recall=0.99999)
    assert kept.columns == docs.columns
    left = [tuple(r)[:2] for r in kept.collect()]
    # of the first group one text of id 5 stays, of the second the only one with an id, and the blank row
    assert sorted(i for i, _ in left) == [5, 5, 5, 9] and {(5, far + " x"), (5, ""), (9, "other words here")} <= set(left)
    some = [tuple(r)[:2] for r in ngram_join.first_of_each(docs.filter("doc_id IS NULL OR doc_id = 7"), recall=0.99999).collect()]
    assert [t for i, t in some if i == 7] == [rows[0][1]] and len(some) == 2 and some[0][1] != some[1][1] and {t for i, t in some if i is None} <= {far, far + " y"}
    assert ngram_join.first_of_each(docs.limit(0)).count() == 0


def test_components_of_a_chain_a_star_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(50)] + [(5000, 5001), (5001, 5002), (5002, 5000), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[2000 + i] == 1000 for i in range(50)) and got[5002] == 5000
