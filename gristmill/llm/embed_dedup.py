"""Near-duplicate embeddings of equal label by sorted projection passes.

Vectors with equal label and components are one class, however many there are. In each pass the classes are ordered by
label and by the concatenated signs of random projections, and each is compared with its neighbours in a window of that
order, by cosine in double precision. The verified pairs of all passes are united to components. Signs are taken of
what is left of a vector after the mean of its label, since a direction that all vectors share would not split them.

The first number of passes follows from the size of the largest label as if every sign halved it. Whether that is enough is
measured: copies of up to ``PROBES`` drawn vectors, turned to the threshold in a random direction, stand in the passes
without linking anything, and rounds of passes follow until the part of them that met the component of their vector
reaches ``recall``. ``MAX_PASSES`` passes without that raise an error.

Windows are bounded, so in a dense group most pairs are not met in any of them. The exact way for the rest: inside
a component all pairs are compared, in blocks of ``BLOCK`` vectors, each pair of blocks in a task of its own, and only
counts leave the task. Pairs of vectors in different components were never closer than the passes could see.

Defined results: a vector links with nothing if its label is null, or it is null, zero or empty or holds a null or
non-finite component; vectors of different length do not link. Rows without ``vec_id`` link with nothing either.
Repeated rows count as other vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import components, cut, small_batches

BLOCK = 1024
WINDOW = 64
CODE_BITS = 60
PROBES = 4000
MAX_PASSES = 4000
#: Coded rows of a sorted partition: borders cut windows, so partitions are not small, and tasks stay bounded.
PART_ROWS = 2048, 65_536


def usable(vec_id: Column, label: Column, vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec_id.isNotNull() & label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def plan_passes(rows: int, window: int, threshold: float, recall: float) -> int:
    """Passes to begin with: about log2(rows / window) signs must agree for a pair to stand within a window of each other."""
    same = 1 - np.arccos(threshold) / np.pi
    meet = same ** max(1.0, np.log2(max(2, rows) / window) + 1)
    return max(2, int(np.ceil(np.log(1 - recall) / np.log(1 - meet)))) if meet < 1 else 2


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.array(rows.tolist(), np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _means(classes: DataFrame) -> DataFrame:
    """(label, size, mean): the mean direction of the vectors of a label and length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (label, size), own in pdf.groupby(["label", "size"], sort=False):
                yield pd.DataFrame({"label": [label], "size": [size], "total": [_unit(own["vector"]).sum(axis=0)], "n": [len(own)]})

    label = classes.schema["label"].dataType.simpleString()
    sums = classes.select("label", "size", "vector").mapInPandas(run, f"label {label}, size int, total array<double>, n bigint")
    each = sums.select("label", "size", "n", F.posexplode("total")).groupBy("label", "size", "pos").agg((F.sum("col") / F.sum("n")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return each.groupBy("label", "size").agg(F.transform(ordered, lambda x: x["m"]).alias("mean"))


def _turned(classes: DataFrame, threshold: float, seed: int) -> DataFrame:
    """Every class with its vector turned in a random direction until its cosine with the old one is the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cosine = threshold + (1 - threshold) * 1e-6
        for pdf in batches:
            out = []
            for node, x in zip(pdf["node"].tolist(), map(np.array, pdf["vector"])):
                x = x / np.abs(x).max()
                x = x / np.linalg.norm(x)
                if len(x) > 1:
                    side = np.random.default_rng([seed, node & (1 << 63) - 1]).standard_normal(len(x))
                    side -= (side @ x) * x
                    x = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * side / np.linalg.norm(side)
                out.append(x)
            yield pdf.assign(vector=out)

    return classes.mapInPandas(run, classes.schema)


def _codes(classes: DataFrame, first: int, passes: int, seed: int) -> DataFrame:
    """One row for each class and pass from number ``first``, with the code that orders the pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        weight = (1 << np.arange(CODE_BITS, dtype=np.int64))[::-1]
        for pdf in batches:
            for size, own in pdf.groupby("size", sort=False):
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size, first]).standard_normal((size, passes * CODE_BITS))
                x = _unit(own["vector"]) - np.array([np.zeros(size) if m is None else m for m in own["mean"]])
                same = {c: own[c].array for c in ("label", "size", "node", "probe", "vector")}
                for k in range(passes):
                    code = (x @ planes[size][:, k * CODE_BITS:(k + 1) * CODE_BITS] > 0) @ weight
                    yield pd.DataFrame({"turn": first + k, "code": code, **same})

    label = classes.schema["label"].dataType.simpleString()
    return classes.mapInPandas(run, f"turn int, label {label}, size int, code bigint, node bigint, probe boolean, vector array<double>")


def _window_edges(coded: DataFrame, window: int, threshold: float) -> DataFrame:
    """(a, b, probe): a spanning forest of the verified pairs that each sorted partition sees in its windows.

    With ``probe`` set, ``a`` is the node whose probe stood near the tree of ``b``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            fresh = 0 if kept is None else len(kept)
            edges = []
            for _, own in rows.groupby(["turn", "label", "size"], sort=False):
                x, node, up = _unit(own["vector"]), own["node"].tolist(), list(range(len(own)))
                probe, seen = own["probe"].to_numpy(bool), []

                def root(i: int, up: list[int] = up) -> int:
                    while up[i] != i:
                        up[i] = up[up[i]]
                        i = up[i]
                    return i

                at = own.index.to_numpy()
                for lo in range(0, len(own), BLOCK):
                    part = x[lo:lo + BLOCK + window]
                    i, j = np.nonzero(np.triu(part @ part.T >= threshold, 1))
                    near = (j - i <= window) & (i < BLOCK) & (at[lo + j] >= fresh)
                    i, j = i[near] + lo, j[near] + lo
                    real = ~(probe[i] | probe[j])
                    for a, b in zip(i[real].tolist(), j[real].tolist()):
                        ra, rb = root(a), root(b)
                        if ra != rb:
                            up[rb] = ra
                            edges.append((node[a], node[b], False))
                    one = probe[i] != probe[j]
                    seen += zip(np.where(probe[i], i, j)[one].tolist(), np.where(probe[i], j, i)[one].tolist())
                edges += {(node[p], node[root(b)], True) for p, b in seen}
            yield pd.DataFrame(edges, columns=["a", "b", "probe"]).astype({"a": np.int64, "b": np.int64, "probe": bool})
            kept = rows.iloc[-window:]

    return coded.mapInPandas(run, "a bigint, b bigint, probe boolean")


def _families(classes: DataFrame, threshold: float, recall: float, window: int, seed: int) -> DataFrame:
    """(node, family) of every class that has a near one, from as many passes as the probes ask for."""
    spark = classes.sparkSession
    label = ["label", "size"]
    sized = classes.select("node", "label", F.size("vector").alias("size"), "vector")
    # the classes of a smaller label always stand within a window of each other
    crowded = cut(sized.groupBy(label).count().filter(F.col("count") > window))
    rows, largest, total = classes.count(), *crowded.agg(F.max("count"), F.sum("count")).first()
    spread = sized.withColumn("probe", F.lit(False))
    share = min(0.5, PROBES / total) if total else 0.0
    if total:
        inside = sized.join(crowded.select(label), label, "left_semi").select(sized.columns)
        drawn = F.pmod(F.xxhash64("node", F.lit("probe")), F.lit(1 << 40)) < int((1 << 40) * share)
        probes = cut(_turned(inside.filter(drawn), threshold, seed).withColumn("probe", F.lit(True)))
        spread = cut(spread.unionByName(probes).join(_means(inside), label, "left"))
        n_probes = probes.count()
    else:
        spread, n_probes = spread.withColumn("mean", F.lit(None).cast("array<double>")), 0
    # probes take places in the order, so the windows are wider by their share
    reach = int(np.ceil(window * (1 + share)))
    order = ["turn", "label", "size", "code", "node"]
    edges, done, passes = None, 0, plan_passes(largest or 0, window, threshold, recall)
    while True:
        coded = (rows + n_probes) * passes
        parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), coded // PART_ROWS[0]), coded // PART_ROWS[1])
        ranged = _codes(spread, done, passes, seed).repartitionByRange(parts, *order).coalesce(parts).sortWithinPartitions(*order)
        found = cut(_window_edges(ranged, reach, threshold))
        edges, done = found if edges is None else edges.unionByName(found), done + passes
        family = components(edges.filter("NOT probe").select("a", "b")).select("node", F.col("root").alias("family"))
        if not n_probes:
            return family
        family = cut(family)
        ends = [family.select(F.col("node").alias(c), F.col("family").alias(f"family_{c}")) for c in "ab"]
        near = edges.filter("probe").select("a", "b").distinct().join(ends[0], "a", "left").join(ends[1], "b", "left")
        met = near.filter("coalesce(family_a, a) = coalesce(family_b, b)").select("a").distinct().count()
        if met >= recall * n_probes:
            return family
        if done >= MAX_PASSES:
            raise RuntimeError(f"{met} of {n_probes} probes met after {done} passes")
        missed = 1 - met / n_probes
        more = done * np.log(1 - recall) / np.log(missed) - done if missed < 1 else 4 * done
        passes = int(np.ceil(min(max(more, done / 4), 4 * done, MAX_PASSES - done)))


def _count_links(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Linked vectors of each class inside the families, or the pair of blocks, of one task."""
    out = []
    for _, fam in pdf.groupby("family", sort=False):
        own = fam["first"].iloc[0] == fam["second"].iloc[0]
        left = fam if own else fam[fam["block"] == fam["first"]]
        right = left if own else fam[fam["block"] == fam["second"]]
        if not len(left) or not len(right):
            continue
        x = _unit(left["vector"])
        hit = x @ (x if own else _unit(right["vector"])).T >= threshold
        if own:
            np.fill_diagonal(hit, False)
        out.append(pd.DataFrame({"node": left["node"].array, "links": hit @ right["copies"].to_numpy()}))
        if not own:
            out.append(pd.DataFrame({"node": right["node"].array, "links": left["copies"].to_numpy() @ hit}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"node": [], "links": []})


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.999, window: int = WINDOW, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding, label)``."""
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    base = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    ok = usable(F.col("vec_id"), F.col("label"), F.col("vector"))
    classes = cut(base.filter(ok).groupBy("label", "vector").agg(F.min("vec_id").cast("long").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn(
        "node", F.col("least")))
    # a vec_id that repeats with other components would name two classes: they are told apart by a hash
    twice = classes.groupBy("least").count().filter("count > 1").select("least")
    if not twice.isEmpty():
        classes = cut(classes.join(twice.withColumn("_twice", F.lit(True)), "least", "left").withColumn(
            "node", F.when(F.col("_twice"), F.xxhash64("label", "vector")).otherwise(F.col("least"))).drop("_twice"))
    family = _families(classes, threshold, recall, window, seed)
    members = cut(classes.join(family, "node").select("node", "family", "vector", "copies"))
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("members")).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    small = sizes.filter("blocks = 1").agg(F.sum("members")).first()[0] or 0
    blocks = members.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
    blocks = blocks.withColumn("pack", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(1 + small // (4 * BLOCK)))).otherwise(F.xxhash64("family")))
    counted = blocks.groupBy("pack", "first", "second", "blocks").applyInPandas(lambda pdf: _count_links(pdf, threshold), "node bigint, links bigint")
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("label", "vector", "node", "least", "copies").join(links, "node", "left").join(family, "node", "left")
    named = named.withColumn("family", F.coalesce("family", "node"))
    ids = named.groupBy("family").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "family").select("label", "vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = base.withColumn("label", F.when(ok, F.col("label")))
    out = rows.join(named, ["label", "vector"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
