from pyspark.sql import functions as F

from gristmill.llm import mixing
from gristmill.llm.queries import five_two_one


def brute_targets(sizes):
    """Share by weight; what is above the cap is shared again among the others, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}
    left, got, open_ = 1.5 * sum(sizes.values()), {}, {s for s in names if sizes[s]}
    while open_:
        total = sum(w[s] for s in open_)
        above = {s for s in open_ if left * w[s] / total > 2 * sizes[s]}
        if not above:
            got |= {s: left * w[s] / total for s in open_}
            break
        for s in above:
            got[s] = 2.0 * sizes[s]
            left -= got[s]
        open_ -= above
    return {s: got.get(s, 0.0) for s in names}


def test_targets_and_taken(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 50)
    rows = [(i, "word " * (i % 37 + 1), f"s{0 if i % 3 else i % 8}") for i in range(1500)]
    rows += [(5000 + i, "a b\tc", None) for i in range(20)] + [(6000, None, "empty"), (6001, " \n ", "empty"), (None, "x y", "s1"), (7, rows[7][1], rows[7][2]), (8000, "### $$$ " * 10_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("target", F.lit(1)).withColumn("weight", F.lit(3)).withColumn("docs", F.lit(3))
    got = mixing.mix(docs, five_two_one()).collect()
    assert len(got) == len(rows)
    size = {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r["size"]
    want = brute_targets(size)
    for s in size:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == size[s] and 0 <= r.taken <= 2 * r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r["size"] for r in own) / 2 + 1e-6
        assert len({r.copies for r in own if r["size"]}) <= 2
    again = mixing.mix(docs.repartition(7), five_two_one()).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(docs.limit(0), five_two_one()).count() == 0


def test_quality_shifts_the_draw(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("good words here")).otherwise(F.lit("b@d w*rds h#r")).alias("text"), F.lit("s").alias("source"))
    got = mixing.mix(docs, F.lit(1.0), budget_share=0.3)
    n = {r[0]: r[1] for r in got.filter("copies > 0").groupBy(F.col("doc_id") % 2).count().collect()}
    assert n[0] > 8 * n.get(1, 1)
