"""Planning and quality of digests against small hand-made tables."""

import random
from collections import Counter

from pyspark.sql import functions as F

from gristmill.operators import catalog_repair as CR
from gristmill.operators import digests as D
from gristmill.operators import verify as V


def greedy(stories, n):
    """Most similar pair first, by comparing all pairs of groups again after each join."""
    groups = [({i}, Counter({**{w: 1 for w in s.split()}, **{w: 2 for w in t.split()}})) for i, t, s in stories]
    while len(groups) > n:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                a, b = groups[i], groups[j]
                sim = sum((a[1] & b[1]).values()) / max(2, min(len(a[1]), len(b[1]))) - (len(a[0]) + len(b[0])) * 0.01
                if best is None or sim > best[0] + 1e-12:
                    best = (sim, i, j)
        _, i, j = best
        groups[i] = (groups[i][0] | groups[j][0], groups[i][1] + groups[j][1])
        del groups[j]
    return {frozenset(g[0]) for g in groups}


def test_section_clusters_equal_the_greedy_rule(spark):
    rng = random.Random(5)
    words = [f"word{c}{d}" for c in "abcdefgh" for d in "xyz"]
    pick = lambda k: " ".join(rng.sample(words, k))
    rows = [(s, i, pick(rng.randint(1, 4)), pick(rng.randint(0, 6))) for s, n in ((1, 3), (2, 5), (3, 11), (4, 1)) for i in range(n)]
    got = {}
    for r in D.section_clusters(spark.createDataFrame(rows, "scan_id int, story_id bigint, title string, summary string")).collect():
        got.setdefault(r.scan_id, {}).setdefault(r.cluster, set()).add(r.story_id)
    for s, n in ((1, 1), (2, 2), (3, 4), (4, 1)):
        assert {frozenset(x) for x in got[s].values()} == greedy([(i, t, m) for k, i, t, m in rows if k == s], n)
        assert [len(got[s][c]) for c in sorted(got[s])] == sorted((len(x) for x in got[s].values()), reverse=True)


def test_thin_themes_fold_until_none_is_left(spark):
    # nine themes of one section each: all but one are thin until everything is in one theme
    sections = [(1, i, i + 1) for i in range(9)] + [(2, 0, 4), (2, 1, 4), (2, 2, 7)] + [(3, 0, 1), (3, 1, 1), (3, 2, 2), (3, 3, 2), (3, 4, 5)]
    members = [(d, s, 100 * d + 10 * s + k, 0) for d, s, _ in sections for k in range(3 if s != 4 else 1)]
    got = {(r.digest_id, r.section_id): r.theme for r in D.fold_thin_themes(
        spark.createDataFrame(sections, "digest_id bigint, section_id bigint, theme int"), spark.createDataFrame(members, "digest_id bigint, section_id bigint, story_id bigint, ord int")).collect()}
    assert {got[1, i] for i in range(9)} == {1} and {got[2, i] for i in range(3)} == {1}
    assert [got[3, i] for i in range(5)] == [1, 1, 2, 2, 1]


def test_relative_quality_compares_before_age(spark):
    digests = spark.createDataFrame([(1, "2024-01-01 00:00:00", False, False), (2, "2024-01-02 00:00:00", False, False), (3, "2024-01-02 00:00:00", False, False), (4, "2024-01-02 00:00:00", False, False)], "digest_id bigint, created string, exported boolean, pool boolean").withColumn("created", F.to_timestamp("created"))
    quality = spark.createDataFrame([(1, 75, "fix", 80, 5), (2, 78, "fix", 78, 0), (3, 90, "ready", 90, 0), (4, 60, "fix", 60, 0)], "digest_id bigint, score bigint, grade string, before_age bigint, age_loss bigint")
    members = spark.createDataFrame([(1, 0, 1, 0), (2, 0, 1, 0), (3, 0, 2, 0), (4, 0, 1, 0)], "digest_id bigint, section_id bigint, story_id bigint, ord int")
    stories = spark.createDataFrame([(1, "Harbour bridge opens to traffic", "https://a.example.org/1"), (2, "Another thing entirely different", "https://a.example.org/2")], "story_id bigint, title string, url string")
    got = {r.digest_id: (r.score, r.repeats) for r in D.digest_quality_relative(digests, quality, members, stories).collect()}
    assert got == {1: (75, False), 2: (78, False), 3: (90, False), 4: (45, True)}


def test_watch_items_of_a_digest_without_sources(spark):
    frames = spark.createDataFrame([(1, ["Up 12.5% now"]), (2, ["Up 12.5% now"])], "k int, watch array<string>")
    got = {r.k: r.bad_items for r in V.watch_bad_count(frames, spark.createDataFrame([(1, "nothing")], "k int, corpus string"), "k").collect()}
    assert got == {1: 1, 2: 0}


def test_html_is_mended(spark):
    rows = ["<p>a</div>", "<b>x", "a</span> b", "<P><b>q</B>", "<br/>x<i>y</b>", "<p>a</p><p>b", None, ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "h string").select(CR.mend_html("h")).collect()]
    assert got == ["<p>a</p>", "<b>x</b>", "a b", "<P><b>q</b></p>", "<br/>x<i>y</i>", "<p>a</p><p>b</p>", None, ""]


def test_corpus_of_all_sources(spark):
    members = spark.createDataFrame([(1, 1, i, i) for i in range(8)], "digest_id int, section_id int, ord int, story_id int")
    stories = spark.createDataFrame([(i, "full", "src", f"Title {i}") for i in range(8)], "story_id int, readable string, source string, title string")
    articles = spark.createDataFrame([(i, f"text {100 + i}") for i in range(8)], "story_id int, text string")
    assert D.source_corpus(members, stories, articles).first().sources == 6
    whole = D.source_corpus(members, stories, articles, top=None).first()
    assert whole.sources == 8 and "107" in whole.corpus


def test_clusters_of_one_scan_compare_only_what_grew():
    # a joined group is compared with the others again, other pairs keep their likeness
    calls = []

    class Bag(dict):
        def items(self):
            calls.append(1)
            return super().items()

    n = 40
    got = D._joined(list(range(n)), [Bag({f"w{i}": 2, f"w{i // 2}": 1}) for i in range(n)], 6)
    assert sorted(i for ids, _ in got for i in ids) == list(range(n)) and len(got) == 6
    assert len(calls) <= n * (n - 1) // 2 + n * n
