"""Target-distribution importance resampling with array-scored weights and a distributed radix sort.

A text's features are its runs of one to three words, hashed to buckets. Counting the buckets of the raw and of the target
texts gives one gain a bucket, an array of fixed length. A document's weight is the sum of the gains of its features, and
adding Gumbel noise that a keyed digest of its id determines makes the highest scores a weighted draw without replacement.

Ranks come from a least-significant-digit radix sort of (score descending, id ascending). Every pass is a stable counting
sort by one digit: rows are counted by (block, digit), running sums over all counts give each block the offset of each
digit, and a row's destination is that offset plus its place among the equal digits of its block. Blocks hold a fixed
number of positions, so no key, however frequent, makes a task larger; digits that all rows share take no pass. Each pass
is written to the checkpoint folder.

Defined results: a null text has no features and a weight of 0; a null id sorts behind all ids of its score and is hashed
as an empty text; equal rows with equal ids get neighbouring ranks; with an empty target all gains follow from t = T = 0;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import cut, small_batches

BUCKETS = 10_000
#: Bits of a digit; a pass counts 2 ** DIGIT_BITS digits at most.
DIGIT_BITS = 16
#: Positions of a block, the most rows that are ordered together.
BLOCK_ROWS = 1 << 18

_UPPER = re.compile("[A-Z]+")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feature_buckets(text: str | None, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of one to three words.

    The checksum of a run continues that of the run without its last word, so no run is ever written out.
    """
    words = [w.encode("utf-8", "replace") for w in _WORD.findall(_UPPER.sub(lambda m: m.group().lower(), text or ""))]
    spaced = [b" " + w for w in words]
    one = list(map(zlib.crc32, words))
    two = list(map(zlib.crc32, spaced[1:], one))
    three = list(map(zlib.crc32, spaced[2:], two))
    return len(words), np.array(one + two + three, np.int64) % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """(bucket, n) over all texts: every task sums an array of its own before anything is shuffled."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(feature_buckets(value.as_py(), buckets)[1], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["bucket", "n"])

    return texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln(target share / raw share)) of every bucket, both shares smoothed by one count a bucket.

    The two tables of (bucket, n) have at most ``buckets`` rows, the only thing that the driver reads.
    """
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, table in ((s, raw), (t, target)):
        for bucket, n in table.collect():
            counts[bucket] = n
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    ratio = [(b + 1.0) * all_s / ((a + 1.0) * all_t) for a, b in zip(s.tolist(), t.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            words, features, weights = [], [], []
            for value in batch.column(1):
                n, buckets = feature_buckets(value.as_py(), len(gain))
                words.append(n)
                features.append(len(buckets))
                weights.append(int(gain[buckets].sum()))
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weights))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noisy(weight: Column, doc_id: Column, seed: str = "42") -> Column:
    """The weight plus a floored Gumbel variate that the digest of ``seed:doc_id`` determines."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    return weight + F.floor(-1000 * F.log(-F.log(share)))


def _digits(rows: DataFrame, keys: list[Column]) -> list[Column]:
    """Digits of the composite key, least significant first; ``keys`` are longs, most significant first.

    Only the bits in which two rows differ make digits: one aggregate finds them.
    """
    union = [F.bit_or(k).alias(f"o{i}") for i, k in enumerate(keys)] + [F.bit_and(k).alias(f"a{i}") for i, k in enumerate(keys)]
    seen = rows.agg(*union).first()
    pieces: list[tuple[int, Column]] = []
    for i in reversed(range(len(keys))):
        differ = ((seen[f"o{i}"] or 0) ^ (seen[f"a{i}"] or 0)) & (2**64 - 1)
        while differ:
            # the next run of differing bits, at most a digit wide
            low = (differ & -differ).bit_length() - 1
            width = min(DIGIT_BITS, differ.bit_length() - low)
            pieces.append((width, F.shiftrightunsigned(keys[i], low).bitwiseAND(F.lit((1 << width) - 1))))
            differ &= ~(((1 << width) - 1) << low)
    # neighbouring pieces share a digit while they fit, the lower piece in the lower bits
    digits: list[Column] = []
    at = 0
    while at < len(pieces):
        used, parts = 0, []
        while at < len(pieces) and used + pieces[at][0] <= DIGIT_BITS:
            parts.append(F.shiftleft(pieces[at][1], used))
            used += pieces[at][0]
            at += 1
        digits.append(reduce(or_, parts[1:], parts[0]) if len(parts) == 1 else reduce(lambda a, b: a.bitwiseOR(b), parts))
    return digits


def radix_ranked(rows: DataFrame, keys: list[Column], rank: str = "rank") -> DataFrame:
    """``rows`` with ``rank``, 1, 2, 3... in the order of ``keys`` (longs, most significant first, compared unsigned).

    ``rows`` must be a checkpointed or written table, since positions start from the order in which it is stored.
    """
    digits = _digits(rows, keys)
    spark = rows.sparkSession
    columns = rows.columns
    # unique, and dense enough for blocks of bounded size; the first pass makes positions consecutive
    now = rows.withColumn("_at", F.monotonically_increasing_id())
    if not digits:
        digits = [F.lit(0).cast("long")]
    for digit in digits:
        now = now.select(*columns, "_at", F.floor(F.col("_at") / BLOCK_ROWS).alias("_block"), digit.cast("int").alias("_digit"))
        counts = cut(now.groupBy("_block", "_digit").agg(F.count(F.lit(1)).alias("_n")))
        # offsets: all smaller digits, then the same digit in earlier blocks
        totals = sorted((r[0], r[1]) for r in counts.groupBy("_digit").agg(F.sum("_n")).collect())
        before, base = 0, []
        for value, n in totals:
            base.append((value, before))
            before += n
        bases = spark.createDataFrame(base, "_digit int, _base long")
        earlier = F.sum("_n").over(Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
        offsets = counts.withColumn("_earlier", F.coalesce(earlier, F.lit(0))).join(F.broadcast(bases), "_digit")
        offsets = offsets.select("_block", "_digit", (F.col("_base") + F.col("_earlier")).alias("_offset"))
        place = F.row_number().over(Window.partitionBy("_block", "_digit").orderBy("_at"))
        moved = now.withColumn("_place", place).join(offsets, ["_block", "_digit"])
        now = cut(moved.select(*columns, (F.col("_offset") + F.col("_place") - 1).alias("_at")))
    return now.select(*columns, (F.col("_at") + 1).alias(rank))


def resample(docs: DataFrame, target: DataFrame, share: float = 0.05, min_words: int = 20, seed: str = "42", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; the drawn ones have a rank.

    Of the documents with at least ``min_words`` words, ``floor(share * count)`` are drawn.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), buckets)
    scored = weighted(docs, gain).withColumn("score", noisy(F.col("weight"), F.col("doc_id"), seed))
    scored = cut(scored)
    eligible = scored.filter(F.col("n_words") >= min_words)
    drawn = math.floor(round(share * 1_000_000) * eligible.count() / 1_000_000)
    out = ["doc_id", "n_features", "weight", "score"]
    top = F.lit(-1 << 63).cast("long")
    # flipping the top bit makes signed order unsigned order, flipping all bits makes it descending
    keys = [F.bitwise_not(F.col("score").bitwiseXOR(top)), F.col("doc_id").isNull().cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).bitwiseXOR(top)]
    ranked = radix_ranked(eligible.select(*out), keys)
    ranked = ranked.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    rest = scored.filter(F.col("n_words") < min_words).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)
