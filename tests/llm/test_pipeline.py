import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from gristmill.llm import ngram_join, tiling
from tests.llm.test_ngram_join import brute as brute_links
from tests.llm.test_tiling import brute_covered

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    rows = [(i, t, "en", None if i is not None and i % 5 == 0 else "s1", None if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, COLUMNS).withColumn("spans", F.lit("x")).withColumn("node", F.lit(1))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    out = [(None, None), (0, None), (1, ""), (2, "one"), (3, "one"), (3, "one")]
    for g in range(20):
        base = [word() for _ in range(80)]
        for k in range(1 + g % 3):
            copy = list(base)
            copy[k] = word()
            out.append((10 + g * 5 + k, " ".join(copy)))
    return out


def test_near_duplicates_leave_one_of_each_group(spark, texts):
    docs = docs_of(spark, texts)
    got = P.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    classes = {}
    for d, c, _ in brute_links(texts):
        if d is not None:
            classes.setdefault(c if c is not None else d, set()).add(d)
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == sorted(min(x) for x in classes.values())


def test_benchmark_stage(spark, texts):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = texts + [(900 + i, f"start {t} end") for i, t in enumerate(items)]
    got = {r.doc_id for r in P.without_benchmark(spark, docs_of(spark, rows), SF).collect()}
    assert got == {d for d, _ in texts} and tiling._GAP and brute_covered(["a"], ["a"], 1) == 1


def test_personal_data_stage(spark):
    docs = docs_of(spark, [(1, "mail a@b.cc now"), (2, None), (3, ""), (None, "+1 (017) 555-7713"), (4, "clean 12 text")])
    out = P.without_personal_data(spark, docs, SF)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text, r.n_chars, r.spans) for r in out.collect()} == {(1, "mail [EMAIL] now", 16, "x"), (2, None, None, "x"), (3, "", 0, "x"), (None, "[PHONE]", 7, "x"), (4, "clean 12 text", 13, "x")}


def test_mix_stage(spark, texts):
    docs = docs_of(spark, texts)
    out = P.mixed(spark, docs, SF)
    assert out.columns == [*docs.columns, "copies"] and all(1 <= r.copies <= 2 for r in out.collect())
    n = lambda t: len((t or "").split())
    total = sum(n(t) for _, t in texts)
    assert abs(sum(r.copies * n(r.text) for r in out.collect()) - 1.5 * total) <= 2 * 80
    assert P.mixed(spark, docs.limit(0), SF).count() == 0


def test_all_stages(spark):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    out = P.run(spark, SF)
    assert out.columns == [*first.columns, "copies"] and 0 < out.count() < first.count()
    texts = [r.text for r in out.collect()]
    assert not any("@" in t and ".com" in t for t in texts)
    again = ngram_join.near_duplicates(out)
    assert again.filter("n_links > 0").count() == 0
    assert tiling.contaminated(out, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert [s for s, _ in P.STAGES] == ["good_quality", "near_duplicates", "without_benchmark", "without_personal_data", "mixed"]
    for name, stage in P.STAGES:
        assert stage(spark, first.limit(0), SF).count() == 0, name
