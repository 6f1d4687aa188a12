"""Mixing sources to target weights.

Targets: the sources share a budget of words by weight; a target stops at ``cap`` times its source's size and the excess
is shared again by weight among the others (water filling, so the result is the same as sharing round by round).

Selection inside a source (Efraimidis-Spirakis): every document draws an exponential key, ``-ln(u) / quality``, from a
hash of its id. The target is first served by complete epochs of the source; the rest goes to the documents in key
order as long as the running sum of words fits. What is then left, less than the next document, goes to the one document
whose size comes nearest to it, if taking it brings the source nearer to its target (the first by key of equals).

A hot source is never sorted in one task: its keys are dealt to buckets by an estimate of their rank, a running sum of the
bucket totals is one small row per ``BUCKET_DOCS`` documents, and only inside a bucket are documents sorted.

Defined results: a null or blank text has size 0 and is never taken; null is a source of its own; a source without words
has target 0; repeated rows draw equal keys and are interchangeable; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.llm.common import BROADCAST_IDS, cut

BUCKET_DOCS = 20_000
LEAST_QUALITY = 0.05


def words(text: Column) -> Column:
    """Number of runs of characters other than space and the controls 9 to 13; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def marks_quality(text: Column, size: Column) -> Column:
    """A quality weight from the text itself: 1 less the odd marks (ASCII marks but comma, hyphen and full stop) a word, at least 0.05."""
    odd = F.coalesce(F.regexp_count(text, F.lit(r"[!-+/:-@\[-`{-~]")), F.lit(0))
    return F.greatest(F.lit(LEAST_QUALITY), F.when(size > 0, (size - odd) / size).otherwise(F.lit(1.0)))


def unit(doc_id: Column) -> Column:
    """A number in (0, 1) from the md5 hash of the id: the same in every run."""
    return (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, budget: float, cap: float) -> DataFrame:
    """(source, source_size, docs, target) from ``sizes(source, source_size, docs, weight)``, one row a source.

    The level L with sum(min(cap * size, L * weight)) = budget is read off the sources in order of the level at which
    each is full. Sources without words or weight get 0.
    """
    full = F.when((F.col("source_size") > 0) & (F.col("weight") > 0), cap * F.col("source_size") / F.col("weight"))
    s = sizes.withColumn("_full", full)
    below = W.orderBy(F.col("_full").asc_nulls_last(), F.col("source")).rowsBetween(W.unboundedPreceding, -1)
    live = s.filter("_full IS NOT NULL").withColumns({
        "_caps": F.coalesce(F.sum(cap * F.col("source_size")).over(below), F.lit(0.0)),
        "_weights": F.sum("weight").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))})
    # the first source that its share does not fill gives the level; none: everything is full
    level = live.withColumn("_level", (F.lit(budget) - F.col("_caps")) / F.col("_weights")).filter("_level <= _full").agg(F.max("_level")).first()[0]
    share = F.col("weight") * float(level) if level is not None else cap * F.col("source_size")
    return s.select("source", "source_size", "docs", F.when(F.col("_full").isNull(), F.lit(0.0)).otherwise(F.least(share, cap * F.col("source_size"))).cast("double").alias("target"))


def mix(docs: DataFrame, weight: Column, budget_share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs(doc_id, source, text)``.

    ``weight`` is the weight of a source, computed over the table of sources, where ``rank`` counts them from 1 by code
    point, null last. ``copies`` says how often the mix repeats the document, ``taken`` how many words that makes.
    """
    return _draw(docs, weight, budget_share, cap).drop("_key", "epochs", "_fits", "_closes")


def mixed_documents(docs: DataFrame, weight: Column, budget_share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``copies``; all other columns as they were.

    The draw gives each source its epochs and the last key that is still taken; texts are not shuffled. Rows that equal
    the last one taken are all taken.
    """
    drawn = _draw(docs, weight, budget_share, cap)
    place = F.struct("_key", "doc_id", "size")
    ends = cut(drawn.groupBy("source").agg(
        F.max(F.when(F.col("_fits"), place)).alias("_last"), F.max(F.when(F.col("_closes"), place)).alias("_close"), F.max("epochs").alias("_epochs")).withColumnRenamed("source", "_s"))
    size = words(F.col("text"))
    key = -F.log(unit(F.col("doc_id"))) / marks_quality(F.col("text"), size)
    rows = _per_source(docs, ends)
    place = F.struct(key.alias("_key"), F.col("doc_id"), size.alias("size"))
    more = (F.coalesce(place <= F.col("_last"), F.lit(False)) | F.coalesce(place.eqNullSafe(F.col("_close")), F.lit(False))).cast("long")
    # a generator, so that the words are counted once and not again to filter on them
    taken = F.filter(F.array(F.when(size > 0, F.col("_epochs") + more).otherwise(F.lit(0))), lambda c: c > 0)
    return rows.select(*[c for c in docs.columns if c != "copies"], F.explode(taken).alias("copies"))


def _per_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with their source's row of a checkpointed ``table(_s, ...)``: broadcast while there are few sources, by count.

    A join that shuffles would bring all texts of a hot source together.
    """
    few = table.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(table) if few else table, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def _draw(docs: DataFrame, weight: Column, budget_share: float, cap: float) -> DataFrame:
    drawn = docs.select("doc_id", "source", "text", words(F.col("text")).alias("size"))
    drawn = drawn.select("doc_id", "source", "size", marks_quality(F.col("text"), F.col("size")).alias("_quality"))
    drawn = cut(drawn.withColumn("_key", -F.log(unit(F.col("doc_id"))) / F.col("_quality")))
    sizes = drawn.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"), F.avg("_quality").alias("_mean"))
    sizes = cut(sizes)
    # one row a source
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weight.cast("double"))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    goal = targets(ranked.select("source", "source_size", "docs", "weight"), budget_share * total, cap).join(
        sizes.select(F.col("source").alias("_s"), "_mean"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = cut(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "_s"))
    rows = _per_source(drawn, goal)
    # keys of documents of mean quality are exponential; their distribution function estimates the rank
    buckets = F.ceil(F.col("docs") / BUCKET_DOCS)
    rows = rows.withColumn("_bucket", F.floor((1 - F.exp(-F.col("_key") * F.col("_mean"))) * buckets).cast("long"))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), before.alias("_before"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    inside = W.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = F.col("_before") + F.sum("size").over(inside)
    rows = rows.withColumn("_reached", reached).withColumn("_fits", (F.col("size") > 0) & (F.col("_reached") <= F.col("rest")))
    rows = cut(rows.select("doc_id", "source", "size", "source_size", "target", "epochs", "rest", "_key", "_reached", "_fits"))
    gap = F.max("rest") - F.coalesce(F.max(F.when(F.col("_fits"), F.col("_reached"))), F.lit(0))
    gaps = cut(rows.groupBy("source").agg(gap.alias("_gap")).withColumnRenamed("source", "_s"))
    rows = _per_source(rows, gaps)
    near = rows.filter(~F.col("_fits") & (F.col("size") > 0) & (F.col("size") < 2 * F.col("_gap")))
    close = near.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("_gap")).alias("off"), "_key", "doc_id", "size")).alias("c"))
    close = cut(gaps.join(close, F.col("_s").eqNullSafe(F.col("source")), "left").select("_s", F.struct("c._key", "c.doc_id", "c.size").alias("_close")))
    rows = _per_source(rows, close).withColumn("_closes", ~F.col("_fits") & F.struct("_key", "doc_id", "size").eqNullSafe(F.col("_close")))
    copies = F.when(F.col("size") > 0, F.col("epochs") + (F.col("_fits") | F.col("_closes")).cast("long")).otherwise(F.lit(0).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "_key", "epochs", "_fits", "_closes")
