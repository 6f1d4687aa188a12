"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of ids is broadcast. The driver holds such a table several times while it builds and sends it.
BROADCAST_IDS = 200_000
#: Bytes of text that a Python task works on at a time.
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, one process on one machine gets a temporary folder, a cluster a folder in its warehouse.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            one_machine = re.fullmatch(r"local(\[[^-]*\])?", sc.master)
            folder = tempfile.mkdtemp(prefix="checkpoints-") if one_machine else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, since texts can be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slices(pdf: pd.DataFrame, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pd.DataFrame]:
    """Cut a batch into runs of rows with about ``limit`` characters of text each (one row at least)."""
    size = pdf[text].str.len().fillna(0).cumsum().to_numpy()
    at = 0
    while at < len(pdf):
        done = size[at - 1] if at else 0
        to = max(at + 1, int((size <= done + limit).sum()))
        yield pdf.iloc[at:to]
        at = to


def by_ids(docs: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Join on ``key`` with a table of ids: broadcast while it is small by count, shuffled beyond that.

    ``ids`` should be a checkpointed or cheap table, since it is counted first.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key, how)


#: Rows of ids that one task handles in the rounds of ``components``.
TASK_ROWS = 200_000


def cut_small(df: DataFrame, rows: int) -> DataFrame:
    """``cut`` in as few tasks as ``rows``, an upper bound, are worth: rounds over small tables cost little."""
    return cut(df.coalesce(max(1, -(-rows // TASK_ROWS))))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node with an edge in ``edges(a, b)``, the smallest node of its component.

    Boruvka rounds: every node picks its smallest neighbour, picks are followed to their end by pointer jumping, and
    edges inside a tree vanish. Each round at least halves the nodes that still have edges, so rounds are logarithmic
    and the loop ends by itself. Hot nodes are harmless: groupings are minima, combined before the shuffle, and each
    join has one row per key on one side.
    """
    live = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    trees = None
    while (rows := live.count()) > 0:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pick = cut_small(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")), 2 * rows)
        nodes = pick.count()
        # two nodes that picked each other: the smaller one is the root
        hook = pick.join(pick.select(F.col("node").alias("up"), F.col("up").alias("back")), "up").select(
            "node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("up")), F.col("node")).otherwise(F.col("up")).alias("up"))
        moved = True
        while moved:
            hook = cut_small(_follow(hook, hook, keep=True), nodes)
            moved = not hook.filter("up <> was").isEmpty()
            hook = hook.drop("was")
        if trees is None:
            trees, first = hook, nodes
        else:
            trees = cut_small(_follow(trees, hook), first)
        ends = [hook.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}")) for c in "ab"]
        live = cut_small(live.join(ends[0], "a").join(ends[1], "b").filter("up_a <> up_b")
                         .select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct(), rows)
    if trees is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    least = trees.groupBy("up").agg(F.min("node").alias("root"))
    return trees.join(least, "up").select("node", "root")


def _follow(trees: DataFrame, hook: DataFrame, keep: bool = False) -> DataFrame:
    nxt = hook.select(F.col("node").alias("up"), F.col("up").alias("upper"))
    was = [F.col("up").alias("was")] if keep else []
    return trees.join(nxt, "up", "left").select("node", F.coalesce("upper", "up").alias("up"), *was)
