"""Documents that share most of their word n-grams: MinHash banding, verified on the full n-gram sets.

Words are runs of non-space characters, lower-cased; an n-gram is five words in a row (a shorter text is one n-gram of
all its words). Steps:

1. one scan gives each document a 128-bit key of its n-gram set and its band hashes; documents with equal sets are one
   *class* from here on, so exact copies cost nothing further, however many there are;
2. the band hashes of the classes are shuffled, every class is tied to the smallest class in its bucket, and the
   connected candidates form *families*;
3. the n-gram sets of the families are built again from the texts and compared: small families are packed many to a
   task, large ones are cut into blocks, and each pair of blocks is one task. Only counts and a spanning forest leave
   a task, never pairs, so a family of near copies costs no quadratic output.

All pairs of a family are verified, also those that never met in a bucket. What can be missed is a pair in different
families; ``bands`` and ``rows`` are chosen so that a pair at the threshold meets with probability ``recall``.

Defined results: a null or blank text has no n-grams, links with nothing and is a class of its own. Repeated rows
count as copies. Rows with a null ``doc_id`` take part like others but name no class. Rows that share a doc_id and differ
in their text are told apart by the keys of their n-gram sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import BROADCAST_IDS, by_ids, components, cut, slices, small_batches
from gristmill.llm.hashing import mix, ngrams, word_hashes

#: n-grams of a family (over all its members) that one block holds, and classes per block.
BLOCK_GRAMS = 400_000
BLOCK_CLASSES = 1024
#: Columns of the incidence matrix that are multiplied at a time.
MATRIX_CELLS = 4_000_000


def plan_bands(threshold: float, recall: float, rows: int = 7) -> int:
    """Bands of ``rows`` rows needed so that a pair at ``threshold`` shares a band with probability ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold ** rows)))


def _permutations(k: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def band_hashes(grams: np.ndarray, bands: int, rows: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band of the MinHash signature of a set of 64-bit n-gram hashes."""
    short = (grams >> np.uint64(32)).astype(np.uint32)
    low = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 2048):
        low = np.minimum(low, (short[at:at + 2048, None] * a[None, :] + b[None, :]).min(axis=0))
    total = np.zeros(bands, np.uint64)
    for column in low.reshape(bands, rows).T:
        total = total * np.uint64(0xD6E8FEB86659FD93) + column
    return mix(total + np.arange(bands, dtype=np.uint64))


def _set_key(grams: np.ndarray) -> bytes:
    """128 bits that name a set of n-grams."""
    with np.errstate(over="ignore"):
        return np.array([grams.sum(dtype=np.uint64), mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).tobytes()


def _sets(pdf: pd.DataFrame, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row position, sorted distinct n-gram hashes) of each row of a batch."""
    words, at = word_hashes([(t or "").lower() for t in pdf["text"]])
    for i in range(len(pdf)):
        yield i, np.unique(ngrams(words[at[i]:at[i + 1]], n))


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, node, grams, bands): the key of the n-gram set (null without n-grams), its size and its band hashes."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _permutations(bands * rows)
        for batch in batches:
            for pdf in slices(batch):
                node, size, band = [None] * len(pdf), [0] * len(pdf), [None] * len(pdf)
                for i, grams in _sets(pdf, n):
                    if len(grams):
                        node[i], size[i] = _set_key(grams), len(grams)
                        band[i] = band_hashes(grams, bands, rows, a, b).view(np.int64)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "node": node, "grams": size, "bands": band})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, node binary, grams bigint, bands array<bigint>")


def keyed(docs: DataFrame, n: int, columns: tuple[str, ...] = ()) -> DataFrame:
    """(columns..., node, grams_of): the key and the n-grams of every text that has any."""
    small_batches(docs.sparkSession)
    kept = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in slices(batch):
                sets = [(i, grams) for i, grams in _sets(pdf, n) if len(grams)]
                own = pdf.iloc[[i for i, _ in sets]]
                yield pd.DataFrame({**{c: own[c].array for c in columns}, "node": [_set_key(g) for _, g in sets], "grams_of": [g.tobytes() for _, g in sets]})

    return docs.select("text", *columns).mapInPandas(run, ", ".join([*kept, "node binary, grams_of binary"]))


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, by products of incidence matrices."""
    both = left if left is right else left + right
    values = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(first) - 1
    often = np.bincount(column)[column] > 1
    column, owner = column[often], owner[often]
    out = np.zeros((len(left), len(right)), np.float64)
    if not len(column):
        return out
    column = np.cumsum(np.concatenate(([True], column[1:] != column[:-1]))) - 1
    width = max(1, MATRIX_CELLS // len(both))
    for at in range(0, int(column[-1]) + 1, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(both), width), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += m[:len(left)] @ (m.T if left is right else m[len(left):].T)
    return out


def _verify(left: pd.DataFrame, right: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of linked members of two blocks."""
    ls = [np.frombuffer(x, np.uint64) for x in left["grams_of"]]
    rs = ls if left is right else [np.frombuffer(x, np.uint64) for x in right["grams_of"]]
    shared = _shared(ls, rs)
    union = np.array([len(x) for x in ls])[:, None] + np.array([len(x) for x in rs])[None, :] - shared
    return np.nonzero(shared >= threshold * union - 1e-9)


def _block_links(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links (counted in documents) and forest edges of one task's families or pair of blocks."""
    out = []
    for _, fam in pdf.groupby("family", sort=False):
        fam = fam.drop_duplicates(["node", "block"])
        own = fam["first"].iloc[0] == fam["second"].iloc[0]
        left = fam if own else fam[fam["block"] == fam["first"]]
        right = left if own else fam[fam["block"] == fam["second"]]
        i, j = _verify(left, right, threshold)
        if own:
            i, j = i[i != j], j[i != j]
        up = list(range(len(left) + (0 if own else len(right))))

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        shift = 0 if own else len(left)
        for x, y in zip(i.tolist(), (j + shift).tolist()):
            rx, ry = root(x), root(y)
            if rx != ry:
                up[max(rx, ry)] = min(rx, ry)
        nodes = left["node"].tolist() + ([] if own else right["node"].tolist())
        ends = [nodes[root(x)] for x in range(len(nodes))]
        links = np.bincount(i, weights=right["copies"].to_numpy()[j], minlength=len(left))
        if not own:
            links = np.concatenate([links, np.bincount(j, weights=left["copies"].to_numpy()[i], minlength=len(right))])
        out.append(pd.DataFrame({"node": nodes, "links": links.astype(np.int64), "peer": ends}))
    return pd.concat(out, ignore_index=True)


def classes_of(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.99, rows: int = 7) -> DataFrame:
    """(doc_id, node, root, class_id, n_links) for every row of ``docs(doc_id, text, ...)``.

    ``node`` is the key of the row's n-gram set and ``root`` the node that names its class, both null without n-grams.
    ``class_id`` is the smallest doc_id among the documents reachable by links, ``n_links`` the number of other
    documents with Jaccard similarity of at least ``threshold``, copies included.
    """
    bands = plan_bands(threshold, recall, rows)
    signed = cut(signatures(docs, n, bands, rows))
    classes = signed.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    classes = cut(classes)
    spread = classes.select("node", F.posexplode("bands").alias("band", "hash"))
    meet = spread.groupBy("band", "hash").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    ties = spread.join(meet.drop("high"), ["band", "hash"]).select(F.col("low").alias("a"), F.col("node").alias("b"))
    family = components(ties).select("node", F.col("root").alias("family"))
    members = classes.drop("bands").join(family, "node")
    sizes = members.groupBy("family").agg(F.greatest(F.ceil(F.sum("grams") / BLOCK_GRAMS), F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES)).cast("int").alias("blocks"))
    members = cut(members.join(sizes, "family"))
    linked = cut(_linked(docs, members, n, threshold))
    roots = components(linked.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "least", "copies").join(links, "node", "left").join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least").alias("class_id"))
    named = named.join(ids, "root").select("node", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("doc_id", "node").join(named, "node", "left").select(
        "doc_id", "node", "root", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.99, rows: int = 7) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of ``docs(doc_id, text, ...)``, as in ``classes_of``."""
    return classes_of(docs, n, threshold, recall, rows).select("doc_id", "class_id", "n_links")


def first_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.99, rows: int = 7) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id, null ids last, and of that id the smallest key.

    Rows without n-grams are classes of their own and all stay.
    """
    found = cut(classes_of(docs, n, threshold, recall, rows).select("doc_id", "node", "root"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    kept = cut(found.filter("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("k")).select("k.doc_id", "k.node"))
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("node").alias("node"))
    # an id of one row is decided by the id; rows of other ids are told apart by their keys
    single = ids.filter("n = 1 AND doc_id IS NOT NULL AND node IS NOT NULL").join(kept.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id")
    many = ids.filter("n > 1 OR doc_id IS NULL").select("doc_id")
    single, many = cut(single), cut(many)
    out = by_ids(docs, single, "doc_id", "left_anti")
    if many.isEmpty():
        return out
    known = many.filter("doc_id IS NOT NULL")
    out = by_ids(out, known, "doc_id", "left_anti").filter("doc_id IS NOT NULL")
    rows_of = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    again = by_ids(rows_of, known, "doc_id", "left_semi").unionByName(rows_of.filter("doc_id IS NULL").select("doc_id", "_row", "text"))
    # one row of each (doc_id, node) goes on, by a number that only this table knows
    again = cut(again.withColumn("_at", F.monotonically_increasing_id()))
    keys = keyed(again, n, ("doc_id", "_at")).groupBy("doc_id", "node").agg(F.min("_at").alias("_at"))
    pick = keys.alias("x").join(kept.alias("y"), F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.node") == F.col("y.node"))).select("x._at")
    blank = again.select("_at").join(keyed(again, n, ("_at",)).select("_at"), "_at", "left_anti")
    stay = again.join(pick.unionByName(blank), "_at", "left_semi").select("_row.*")
    return out.unionByName(stay)


def _linked(docs: DataFrame, members: DataFrame, n: int, threshold: float) -> DataFrame:
    """(node, links, peer) rows of all families: links found by one task, and an edge to a linked class."""
    # one text per class is enough; where an id names one class only, its rows are found by the id and the key is compared
    wanted = members.select(F.col("least").alias("doc_id"), F.col("node").alias("wanted"), "family", "blocks", "copies")
    schema = "node binary, family binary, blocks int, copies bigint, grams_of binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in slices(batch):
                keep, found = [], []
                wanted_keys = pdf["wanted"].tolist()
                for i, grams in _sets(pdf, n):
                    if len(grams) and _set_key(grams) == wanted_keys[i]:
                        keep.append(i)
                        found.append(grams.tobytes())
                got = pdf.iloc[keep]
                yield pd.DataFrame({"node": got["wanted"].array, "family": got["family"].array, "blocks": got["blocks"].array, "copies": got["copies"].array, "grams_of": found})

    shared = cut(wanted.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select("doc_id"))
    texts = docs.select("doc_id", "text")
    alone = wanted.join(shared.filter("doc_id IS NOT NULL"), "doc_id", "left_anti").filter("doc_id IS NOT NULL")
    alone = cut(alone)
    # the ids alone choose the texts; only chosen texts travel to their keys and families, which are wide and never broadcast
    chosen = by_ids(texts, alone.select("doc_id"), "doc_id", "left_semi")
    sets = chosen.join(alone.hint("merge"), "doc_id").select("text", "wanted", "family", "blocks", "copies").mapInPandas(run, schema)
    if not shared.isEmpty():
        # joining on such an id would pair all of its rows with all of its classes: these meet by the key of the set
        again = by_ids(texts, shared.filter("doc_id IS NOT NULL"), "doc_id", "left_semi").unionByName(texts.filter("doc_id IS NULL"))
        of = wanted.join(F.broadcast(shared) if shared.count() <= BROADCAST_IDS else shared, wanted["doc_id"].eqNullSafe(shared["doc_id"]), "left_semi")
        by_key = keyed(again, n).dropDuplicates(["node"]).join(of.withColumnRenamed("wanted", "node").drop("doc_id"), "node")
        sets = sets.unionByName(by_key.select("node", "family", "blocks", "copies", "grams_of"))
    total = members.filter("blocks = 1").agg(F.sum("grams")).first()[0] or 0
    packs = max(1, int(total // BLOCK_GRAMS))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    sets = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
    # small families share a task; a block pair of a large family is a task of its own
    sets = sets.withColumn("pack", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(packs))).otherwise(F.xxhash64("family")))
    return sets.groupBy("pack", "first", "second", "blocks").applyInPandas(
        lambda pdf: _block_links(pdf, threshold), "node binary, links bigint, peer binary")
