import random
from itertools import combinations

from pyspark.sql import functions as F

from gristmill.operators import feeds as FE
from gristmill.operators import related as RL

WORDS = [f"word{i}" for i in range(14)]


def stories(spark, n=70, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        title = rows[-1][1] if rows and rnd.random() < 0.3 else " ".join(rnd.sample(WORDS, rnd.randint(1, 7)))
        rows.append((i, title, f"src{rnd.randint(0, 5)}", f"https://h{rnd.randint(0, 4)}.com/{rnd.randint(0, 40)}", rnd.choice(["open", "paywalled", "open"])))
    return rows, spark.createDataFrame(rows, "story_id bigint, title string, source string, url string, readable string")


def test_coverage_against_every_pair(spark):
    rows, df = stories(spark)
    want = {}
    for i, t, s, *_ in rows:
        a, outs = set(t.split()), {s}
        if len(a) >= 3:
            for j, t2, s2, *_ in rows:
                b = set(t2.split())
                if i != j and len(b) >= 3 and len(a & b) >= 3 and len(a & b) / min(len(a), len(b)) >= 0.55:
                    outs.add(s2)
        want[i] = len(outs)
    assert {r.story_id: r.coverage for r in FE.coverage(df).collect()} == want


def test_related_against_every_pair(spark):
    rows, df = stories(spark, seed=2)
    want = set()
    for i, t, *_ in rows:
        a, hits = set(t.split()), []
        for j, t2, *_ in rows:
            b = set(t2.split())
            c = len(a & b)
            if i != j and (c >= 3 or (c >= 2 and c / min(len(a), len(b)) >= 0.5)):
                hits.append((-c, j))
        want |= {(i, j, -c) for c, j in sorted(hits)[:4]}
    assert {(r.story_id, r.other_id, r.shared) for r in FE.related_stories(df, 4).collect()} == want


def test_second_outlet_against_every_pair(spark):
    rows, df = stories(spark, seed=4)
    host = lambda u: u.split("/")[2]
    want = set()
    for i, t, s, u, _ in rows:
        a, hits = set(t.split()), []
        for j, t2, s2, u2, r2 in rows:
            b = set(t2.split())
            c = len(a & b)
            if i != j and len(a) >= 3 and r2 == "open" and host(u) != host(u2) and s != s2 and (c >= 3 or (c >= 2 and c / min(len(a), len(b)) >= 0.5)):
                hits.append((-c, j))
        want |= {(i, j) for _, j in sorted(hits)[:3]}
    assert {(r.story_id, r.other_id) for r in FE.second_outlet(df).collect()} == want


def test_components_against_union_find(spark):
    rnd = random.Random(9)
    edges = [(rnd.randint(0, 40), rnd.randint(0, 40)) for _ in range(30)] + [(i, i + 1) for i in range(50, 70)]
    edges = [(a, b) for a, b in edges if a != b]
    par = list(range(80))
    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for a, b in edges:
        par[max(find(a), find(b))] = min(find(a), find(b))
    got = RL.components(spark.range(80).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r.node: r.label for r in got.collect()} == {i: find(i) for i in range(80)}


def test_first_wins_is_the_walk_in_order(spark):
    rnd = random.Random(7)
    rows = [(i, f"headline {rnd.randint(0, 12)}", f"https://a.com/{rnd.randint(0, 12)}") for i in range(60)]
    seen, want = set(), []
    for i, t, u in rows:
        if t in seen or u in seen:
            continue
        seen |= {t, u}
        want.append(i)
    df = spark.createDataFrame(rows, "story_id bigint, title string, url string")
    assert sorted(r.story_id for r in FE.first_wins_dedupe(df, "story_id").collect()) == want


def test_event_groups(spark):
    rows, df = stories(spark, seed=6)
    sets = {i: set(t.split()) for i, t, *_ in rows}
    par = {i: i for i in sets}
    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for i, j in combinations(sets, 2):
        if len(sets[i] & sets[j]) / max(3, min(len(sets[i]), len(sets[j]))) >= 0.4:
            par[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, _, s, *_ in rows:
        groups.setdefault(find(i), []).append((i, s))
    want = {i: g for g, m in groups.items() if len(m) > 1 and len({s for _, s in m}) > 1 for i, _ in m}
    assert {r.story_id: r.group_id for r in FE.event_groups(df).collect()} == want


def test_no_nested_loop_in_pair_joins(spark):
    _, df = stories(spark)
    for out in (FE.coverage(df), FE.related_stories(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def pairs_of(rows, rule):
    sets = {i: set(t.split()) for i, t, *_ in rows}
    return {(i, j, len(sets[i] & sets[j])) for i in sets for j in sets if i != j and len(sets[i] & sets[j]) >= rule(min(len(sets[i]), len(sets[j])))}


def test_blocks_and_small_steps_give_the_same_pairs(spark, monkeypatch):
    monkeypatch.setattr(RL, "BLOCK_SETS", 9)
    monkeypatch.setattr(RL, "HITS", 7)
    rows, df = stories(spark, seed=8)
    own = F.split("title", " ").alias("tokens")
    left = RL.coded(df.select(F.col("story_id").alias("id"), own), RL.event_rule)
    right = RL.coded(df.select(F.col("story_id").alias("id"), own, F.col("story_id").alias("p"), (F.col("story_id") * 2).alias("q")), RL.event_rule, "p", "q")
    want = pairs_of(rows, lambda m: -(-max(3, m) * 2 // 5))
    got = {(r.left_id, r.p, r.shared) for r in RL.all_matches(left, right).collect() if r.left_id != r.p}
    assert got == want
    counts = {(r.p, r.q): r.n for r in RL.all_matches(left, right, counts=True).collect()}
    hits = {i: sum(1 for a, b, _ in want if b == i) + (len(set(t.split())) >= -(-max(3, len(set(t.split()))) * 2 // 5)) for i, t, *_ in rows}
    assert counts == {(i, 2 * i): n for i, n in hits.items() if n}
    best = {}
    for r in RL.best_matches(left, right, 3).collect():
        best.setdefault(r.left_id, set()).add((r.other_id, r.shared))
    every = want | {(i, i, len(set(t.split()))) for i, t, *_ in rows if len(set(t.split())) >= -(-max(3, len(set(t.split()))) * 2 // 5)}
    for i in {a for a, _, _ in every}:
        assert best[i] == {(b, n) for n, b in sorted(((n, b) for a, b, n in every if a == i), key=lambda x: (-x[0], x[1]))[:3]}


def test_forest_of_a_dense_group_is_small(spark, monkeypatch):
    monkeypatch.setattr(RL, "BLOCK_SETS", 100)
    rows = [(i, [f"w{i}", "alpha", "beta", "gamma"]) for i in range(300)] + [(300 + i, [f"v{i}", "delta", f"u{i}"]) for i in range(20)]
    sets = RL.coded(spark.createDataFrame(rows, "id bigint, tokens array<string>"), RL.event_rule)
    edges = RL.match_forest(sets)
    # four tasks, each fewer pairs than its left and all right sets; 44,850 pairs meet the rule
    assert edges.count() < 4 * (320 + 100)
    nodes = spark.range(320).select(F.col("id").alias("node"))
    labels = {r.node: r.label for r in RL.components(nodes, edges).collect()}
    assert all(labels[i] == 0 for i in range(300)) and all(labels[i] == i for i in range(300, 320))


def test_coverage_of_rare_and_frequent_tokens_equals_brute_force(spark):
    rnd = random.Random(11)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(600)]
    weights = [1 / (i + 1) for i in range(600)]
    rows, titles = [], []
    for i in range(500):
        title = rnd.choices(words, weights, k=rnd.randint(1, 14)) if i % 3 or not titles else rnd.choice(titles)[:] + rnd.choices(words, weights, k=2)
        titles.append(title)
        rows.append((i, " ".join(title), rnd.choice(["a", "B", "b", "c", "d", "e", None])))
    sets, outlet = [set(t) for t in titles], [(r[2] or "").lower() for r in rows]
    near = lambda x, y: min(len(x), len(y)) >= 3 and len(x & y) >= max(3, -(-55 * min(len(x), len(y)) // 100))
    want = {i: len({outlet[i]} | {outlet[j] for j in range(500) if near(sets[i], sets[j])} if len(sets[i]) >= 3 else {0}) for i in range(500)}
    df = spark.createDataFrame(rows, "story_id int, title string, source string")
    assert {r.story_id: r.coverage for r in FE.coverage(df).collect()} == want
    changed = df.filter("story_id % 50 = 7").select("title")
    got = {r.story_id: r.coverage for r in FE.coverage(df, changed).collect()}
    assert got == {i: want[i] for i in got}
    moved = [sets[i] for i in range(7, 500, 50)]
    assert set(got) == {i for i in range(500) if any(sets[i] == m or near(sets[i], m) for m in moved)}


def test_plans_of_coverage_stay_small(spark):
    # the pairs were one plan of some hundred steps, which filled the driver
    df = spark.createDataFrame([(1, "alpha bravo charlie", "a"), (2, "alpha bravo delta charlie", "b")], "story_id int, title string, source string")
    for changed in (None, df.select("title")):
        found = FE.coverage(df, changed)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") < 8
        assert {r.coverage for r in found.collect()} == {2}
