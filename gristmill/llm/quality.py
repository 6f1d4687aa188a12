"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

A text is the mean of its hashed features: words, pairs of neighbouring words, the shapes of words (letters and digits
folded to classes) and pairs of shapes, and a mark for a word that repeats the one before. The score is the logistic
function of the sparse dot product of these features with the weights.

Training uses a bounded sample of the labelled rows (``max_rows``, drawn by a hash of the id). The sample is dealt to
shards of at least ``SHARD_ROWS`` rows; each shard runs FTRL-Proximal over its rows in hash order, and the weights of the shards are
averaged. The averaged vector has ``2 ** BITS`` entries at most, which bounds what is broadcast for scoring.

Defined results: a null or blank text scores like a text without features (the bias alone). Labels with null fields are ignored, and so are ids with contradicting labels.
Without any usable label every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import slices, small_batches
from gristmill.llm.hashing import mix, word_hashes

BITS = 18
SHARDS = 6
SHARD_ROWS = 1000
#: Updates that the shards make at least, if need be in more passes over their rows.
LEAST_UPDATES = 8000
SCALE = 12.0
_SHAPE = bytes.maketrans(
    bytes(range(97, 123)) + bytes(range(65, 91)) + bytes(range(48, 58)) + bytes(range(128, 256)),
    b"a" * 26 + b"A" * 26 + b"0" * 10 + b"a" * 128)
_FOLDED = np.zeros(256, bool)
_FOLDED[[97, 65, 48]] = True


def _shape(text: str) -> str:
    """The text with runs of letters and digits folded to one character per class."""
    b = np.frombuffer(text.encode("utf-8", "replace").translate(_SHAPE), np.uint8)
    keep = np.ones(len(b), bool)
    keep[1:] = ~((b[1:] == b[:-1]) & _FOLDED[b[1:]])
    return b[keep].tobytes().decode("ascii", "replace")


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of all texts, offsets): the same number may occur several times in a text."""
    words, at = word_hashes(texts)
    shapes, sat = word_hashes([_shape(t) for t in texts])
    out, offsets = [], [0]
    shift = np.uint64(64 - BITS)
    for i in range(len(texts)):
        w, s = words[at[i]:at[i + 1]], shapes[sat[i]:sat[i + 1]]
        found = [w, mix(w[1:] * np.uint64(3) + w[:-1]), mix(s + np.uint64(1)), mix(s[1:] * np.uint64(5) + s[:-1]),
                 np.full(int((w[1:] == w[:-1]).sum()), 1 << 63, np.uint64)]
        found = np.concatenate(found) >> shift
        out.append(found.astype(np.int32))
        offsets.append(offsets[-1] + len(found))
    return (np.concatenate(out) if out else np.empty(0, np.int32)), np.array(offsets)


def train(texts: list[str], labels: np.ndarray, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """FTRL-Proximal over the rows in the given order; returns the weights, the bias last."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    f, at = features(texts)
    rows = []
    for i in range(len(texts)):
        idx, count = np.unique(f[at[i]:at[i + 1]], return_counts=True)
        x = SCALE * count / max(1, at[i + 1] - at[i])
        rows.append((np.append(idx, size - 1), np.append(x, 1.0)))

    def weights(idx: np.ndarray | slice) -> np.ndarray:
        w = -(z[idx] - np.sign(z[idx]) * l1) / ((beta + np.sqrt(n[idx])) / alpha + l2)
        return np.where(np.abs(z[idx]) <= l1, 0.0, w)

    for _ in range(epochs):
        for (idx, x), y in zip(rows, labels):
            w = weights(idx)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / alpha
            z[idx] += g - sigma * w
            n[idx] += g * g
    return weights(slice(None))


def held_out(doc_id: Column) -> Column:
    """The rows of the test fold: crc32 of the id as text, modulo 5, is 0. A null id belongs to no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, least_epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.0) -> np.ndarray:
    """Weights from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``, from at most about ``max_rows`` labelled rows.

    The caller decides which labels may be learned from. The labels are the only table that is counted.
    """
    small_batches(docs.sparkSession)
    usable = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_other"))
    usable = usable.filter("quality = _other AND quality IN (0, 1)").select("doc_id", "quality")
    total = usable.count()
    if not total:
        return np.zeros((1 << BITS) + 1)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40))
    sample = usable.filter(draw < int((1 << 40) * min(1.0, max_rows / total)))
    rows_at_most = min(total, max_rows)
    shards = max(1, min(SHARDS, rows_at_most // SHARD_ROWS))
    epochs = max(least_epochs, LEAST_UPDATES // rows_at_most)
    # the sample is bounded by max_rows, so it may be broadcast whatever the size of the labels
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "text"], kind="stable")
        w = train([t or "" for t in pdf["text"]], pdf["quality"].to_numpy(float), epochs, alpha, beta, l1, l2)
        at = np.flatnonzero(w)
        return pd.DataFrame({"feature": np.append(at, -1), "weight": np.append(w[at], 1.0)})

    models = rows.withColumn("order", F.xxhash64("doc_id", F.lit("order"))).groupBy("shard").applyInPandas(one, "feature int, weight double")
    w, trained = np.zeros((1 << BITS) + 1), 1.0
    for feature, total_weight in models.groupBy("feature").agg(F.sum("weight")).collect():
        if feature < 0:
            trained = total_weight
        else:
            w[feature] = total_weight
    return w / trained


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) for every row, from the whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for batch in batches:
            for pdf in slices(batch):
                yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "score": scores([t or "" for t in pdf["text"]], w)})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def scores(texts: list[str], w: np.ndarray) -> np.ndarray:
    f, at = features(texts)
    total = np.concatenate(([0.0], np.cumsum(w[f], dtype=np.float64)))
    logit = SCALE * (total[at[1:]] - total[at[:-1]]) / np.maximum(1, np.diff(at)) + w[-1]
    return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def keep_good(docs: DataFrame, weights: np.ndarray, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, all columns as they were."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pd.DataFrame({"text": batch.column("text").to_pylist()}, dtype=object)
            good = [scores([t or "" for t in pdf["text"]], shared.value) >= least for pdf in slices(texts)]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.empty(0, bool)))

    return docs.mapInArrow(run, docs.schema)
