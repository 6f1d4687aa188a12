import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from gristmill.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    weights = quality.fit(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    got = quality.score(docs, weights).join(labels, "doc_id").toPandas()
    test = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]]
    good, bad = test.loc[test.quality == 1, "score"].to_numpy(), test.loc[test.quality == 0, "score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95 and len(test) > 40


def test_edges(spark):
    rng = random.Random(2)
    clean = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(40))
    rows = [(i, clean() if i % 2 else clean().replace(" ", "### ")) for i in range(400)] + [(900, None), (901, ""), (902, "x " * 200_000), (None, "alpha"), (1, clean())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("quality", F.lit(7))
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(5, 0), (6, None), (None, 1), (7, 5)], "doc_id long, quality int").withColumn("text", F.lit("x"))
    w = quality.fit(docs, labels)
    assert np.array_equal(w, quality.fit(docs, labels))
    got = quality.score(docs, w).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in got if r.doc_id is not None and 300 <= r.doc_id < 400)
    kept = quality.keep_good(docs, w)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if (r.doc_id or 999) < 900} == set(range(1, 400, 2))
    assert quality.score(docs.limit(0), w).count() == 0
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
