"""Similar-set joins: stories about the same event, digests sharing stories, components over them.

The naive form compares every pair. Here equal sets are collapsed first, tokens are ordered rarest first, and
two sets are compared only when they share a token inside a short prefix: if two sets have at least ``t`` tokens
in common, the first ``n - t + 1`` tokens of each must overlap. No candidate is dropped, so the result is exact,
and frequent tokens, which sit at the end of the order, almost never create candidates.

Where two or three common tokens are enough, prefixes leave most pairs in and the pairs themselves grow with the square of
the sets. ``best_matches``, ``all_matches``, ``match_counts`` and ``match_forest`` therefore meet the sets in blocks: a task
holds one block of left sets, the right sets stream past it, and only what is asked for (the best few, counts, a spanning
forest) leaves it. Every pair is counted; tokens are compared by their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.session import cut_lineage

Required = Callable[[Column], Column]

#: Left sets that a task holds, the least worth a task of their own, and common tokens counted at a time.
BLOCK_SETS, LEAST_SETS, HITS = 50_000, 2_000, 2_000_000
#: Frequent tokens that are kept as bits of a set, and left sets that a task holds where they are.
FREQUENT, WIDE_SETS = 256, 200_000


def share_rule(percent: int, least: int, most: int | None = None) -> Required:
    """Tokens that must be shared when the smaller set has ``m``: ``percent`` of m, at least ``least``.

    Integer arithmetic, so that 11 of 20 really is 55 percent.
    """
    def req(m: Column) -> Column:
        need = F.greatest(F.lit(least), F.ceil((m * percent) / 100).cast("int"))
        return F.least(F.lit(most), need) if most is not None else need
    return req


def event_rule(m: Column) -> Column:
    """Shared / max(3, m) >= 0.4."""
    return F.ceil(F.greatest(F.lit(3), m) * 2 / 5).cast("int")


COVERAGE = share_rule(55, 3)
RELATED = share_rule(50, 2, most=3)


def set_key(tokens) -> Column:
    """Text identity of a token set."""
    return F.array_join(F.array_sort(tokens), " ")


def ordered_sets(sets: DataFrame) -> DataFrame:
    """(key, tokens, n) with tokens rarest first."""
    ex = sets.select("key", F.explode("tokens").alias("token"))
    freq = ex.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    return (
        ex.join(freq, "token").groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("freq", "token"))).alias("_o"))
        .select("key", F.transform("_o", lambda x: x["token"]).alias("tokens"), F.size("_o").alias("n")))


def similar_pairs(sets: DataFrame, required: Required, least_size: int = 1, touched: DataFrame | None = None) -> DataFrame:
    """(a, b, shared) for different keys that meet the rule, each pair once (a is the smaller set).

    ``sets`` has one row per distinct ``key`` with an array ``tokens`` of distinct texts. With ``touched(key)`` only pairs
    with at least one touched key are looked for, so a small change of a large collection costs a small join.
    """
    o = ordered_sets(sets).filter(F.col("n") >= least_size)
    flags = []
    if touched is not None:
        o = o.join(touched.select("key").distinct().withColumn("_hit", F.lit(True)), "key", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
        flags = ["_hit"]
    small = o.withColumn("t", required(F.col("n"))).filter(F.col("t") <= F.col("n"))
    small = small.select(F.col("key").alias("a"), F.col("tokens").alias("ta"), F.col("n").alias("na"), "t", *flags,
                         F.explode(F.slice("tokens", F.lit(1), F.col("n") - F.col("t") + 1)).alias("token"))
    classes = F.array_distinct(F.transform(F.sequence(F.lit(least_size), F.col("n")), required))
    large = o.select(F.col("key").alias("b"), F.col("tokens").alias("tb"), F.col("n").alias("nb"), *flags, F.explode(classes).alias("t"))
    large = large.filter(F.col("t") <= F.col("nb")).select(
        "b", "tb", "nb", "t", *flags, F.explode(F.slice("tb", F.lit(1), F.col("nb") - F.col("t") + 1)).alias("token"))
    if touched is None:
        j = small.join(large, ["t", "token"])
    else:
        near = small.filter("_hit").drop("_hit").join(large.drop("_hit"), ["t", "token"])
        j = near.unionByName(small.filter("NOT _hit").drop("_hit").join(large.filter("_hit").drop("_hit"), ["t", "token"]))
    j = j.filter((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    common = F.array_intersect("ta", "tb")
    j = j.withColumn("_c", common).withColumn("shared", F.size("_c"))
    # a pair may meet on several prefix tokens; it is kept on its first common token only
    return j.filter((F.col("shared") >= F.col("t")) & (F.get("_c", F.lit(0)) == F.col("token"))).select("a", "b", "shared")


def sharing_pairs(left: DataFrame, right: DataFrame, required: Required) -> DataFrame:
    """(a, b, shared) between two collections where the left set alone decides how much must be shared.

    Only the first ``n - t + 1`` tokens of a left set, rarest on the right first, look for partners.
    """
    freq = right.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    ex = left.select("key", F.explode("tokens").alias("token")).join(freq, "token", "left")
    o = ex.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "token"))).alias("_o"))
    o = o.select(F.col("key").alias("a"), F.transform("_o", lambda x: x["token"]).alias("ta"), F.size("_o").alias("n")).withColumn("t", required(F.col("n")))
    probe = o.filter("t <= n").select("a", "ta", "t", F.explode(F.slice("ta", F.lit(1), F.col("n") - F.col("t") + 1)).alias("token"))
    index = right.select(F.col("key").alias("b"), F.col("tokens").alias("tb"), F.explode("tokens").alias("token"))
    j = probe.join(index, "token").withColumn("_c", F.array_intersect("ta", "tb")).withColumn("shared", F.size("_c"))
    return j.filter((F.col("shared") >= F.col("t")) & (F.get("_c", F.lit(0)) == F.col("token"))).select("a", "b", "shared")


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): connected components, label = smallest node of the component.

    Every node picks its smallest neighbour; of two that picked each other the smaller is a root, and pointer jumping
    takes each node to its root. Edges between roots are the next round's graph. A round halves the nodes with edges at
    least, so the rounds are logarithmic and the loop ends by itself. Lineage is cut by a reliable checkpoint each step;
    all groupings are minima and each join has one row per key on one side, so a hub is no hot task.
    """
    live = cut_lineage(edges.filter("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct())
    tree = None
    while not live.isEmpty():
        pick = cut_lineage(live.unionByName(live.select(F.col("y").alias("x"), F.col("x").alias("y"))).groupBy(F.col("x").alias("node")).agg(F.min("y").alias("up")))
        picked = pick.select(F.col("node").alias("up"), F.col("up").alias("back"))
        up = pick.join(picked, "up").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("up")), F.col("node")).otherwise(F.col("up")).alias("up"))
        while True:
            up = cut_lineage(_jump(up, up).withColumn("moved", F.col("up") != F.col("was")))
            settled = up.filter("moved").isEmpty()
            up = up.select("node", "up")
            if settled:
                break
        tree = up if tree is None else cut_lineage(_jump(tree, up).select("node", "up"))
        rx, ry = up.select(F.col("node").alias("x"), F.col("up").alias("rx")), up.select(F.col("node").alias("y"), F.col("up").alias("ry"))
        live = cut_lineage(live.join(rx, "x").join(ry, "y").filter("rx <> ry").select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).distinct())
    if tree is None:
        return nodes.select("node", F.col("node").alias("label"))
    least = tree.groupBy("up").agg(F.min("node").alias("label"))
    labels = tree.join(least, "up").select("node", "label")
    return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _jump(tree: DataFrame, up: DataFrame) -> DataFrame:
    """Each node's parent's parent; a parent without one stays."""
    above = up.select(F.col("node").alias("up"), F.col("up").alias("above"))
    return tree.join(above, "up", "left").select("node", F.coalesce("above", "up").alias("up"), F.col("up").alias("was"))


# ---- sets met in blocks -------------------------------------------------------------------------------------------------
class _Block:
    """The left sets of one task: their token hashes in order, each with the sets that hold it."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.id, self.t = (table.column(c).to_numpy() for c in ("id", "t"))
        self.columns = table
        codes, owner = _tokens(table.column("codes").combine_chunks())
        order = np.argsort(codes, kind="stable")
        codes, self.owner = codes[order], owner[order]
        self.codes, self.start = np.unique(codes, return_index=True)
        self.held = np.diff(np.append(self.start, len(codes)))

    def meet(self, right: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(left position, right position, tokens shared) of the pairs that meet the rule, right positions ascending."""
        codes, column = _tokens(right.column("codes"))
        need = right.column("t").to_numpy()
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[at] == codes
        at, column = at[known], column[known]
        hits = np.cumsum(self.held[at])
        lo = 0
        while lo < len(at):
            # whole right sets, so that every pair is counted at one time
            hi = int(np.searchsorted(hits, (hits[lo - 1] if lo else 0) + HITS, "right"))
            if hi < len(at):
                hi = int(np.searchsorted(column, column[hi])) if column[hi] > column[lo] else int(np.searchsorted(column, column[lo], "right"))
            size, first = self.held[at[lo:hi]], self.start[at[lo:hi]]
            base = np.cumsum(size) - size
            place = np.arange(int(size.sum())) + np.repeat(first - base, size)
            cell = np.repeat((column[lo:hi] - column[lo]) * len(self.id), size) + self.owner[place]
            cell.sort()
            edge = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            shared = np.diff(np.append(edge, len(cell)))
            cell = cell[edge]
            l, r = cell % len(self.id), cell // len(self.id) + column[lo]
            met = shared >= np.minimum(self.t[l], need[r])
            yield l[met], r[met], shared[met]
            lo = hi


def frequent(coded_sets: DataFrame, n: int = FREQUENT) -> np.ndarray:
    """The hashes of the ``n`` most frequent tokens, the rarest of them first."""
    often = coded_sets.select(F.explode("codes").alias("code")).groupBy("code").count().orderBy(F.desc("count"), "code").limit(n)
    return np.array([r.code for r in often.collect()][::-1], np.int64)


class _BitBlock(_Block):
    """A block whose frequent tokens are bits of each set, so that most common tokens cost no look at a list.

    Every pair that can meet the rule is looked at: it shares a rare token, or its common tokens are all frequent. Then one of
    both sets, of ``n`` tokens and with ``t`` to share, has one of them among its ``n - t + 1`` rarest tokens.
    """

    def __init__(self, batches: list[pa.RecordBatch], often: np.ndarray):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.id, self.t = (table.column(c).to_numpy() for c in ("id", "t"))
        self.order = np.argsort(often)
        self.often = often[self.order]
        rare, often_, early, self.bits = self._parted(table.column("codes").combine_chunks(), self.t)
        self.rare, self.all, self.early = _Index(*rare), _Index(*often_), _Index(*early)

    def _parted(self, lists: pa.Array, t: np.ndarray) -> tuple:
        """(tokens, owners) that are rare, that are frequent, and that are frequent among the rarest ``n - t + 1``; bits."""
        codes, owner = _tokens(lists)
        bits = np.zeros((-(-FREQUENT // 64), len(lists)), np.uint64)
        if not len(self.often):
            none = codes[:0], owner[:0]
            return (codes, owner), none, none, bits
        at = np.minimum(np.searchsorted(self.often, codes), len(self.often) - 1)
        known = self.often[at] == codes
        rank, who = self.order[at[known]], owner[known]
        np.bitwise_or.at(bits, (rank // 64, who), np.uint64(1) << (rank % 64).astype(np.uint64))
        size = np.bincount(owner, minlength=len(lists))
        order = np.lexsort((rank, who))
        rank, who = rank[order], who[order]
        head = np.searchsorted(who, who)
        place = size[who] - np.bincount(who, minlength=len(lists))[who] + np.arange(len(who)) - head
        early = place < size[who] - t[who] + 1
        return (codes[~known], owner[~known]), (rank, who), (rank[early], who[early]), bits

    def meet(self, right: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        need, n = right.column("t").to_numpy(), len(self.id)
        rare, often, early, bits = self._parted(right.column("codes"), need)
        probes = [(self.rare, 1, *rare), (self.all, 0, *early), (self.early, 0, *often)]
        # right sets in runs of about HITS common tokens
        per = sum(np.bincount(who, index.hits(codes), minlength=right.num_rows) for index, _, codes, who in probes)
        total, lo = np.cumsum(per), 0
        probes = [(index, weight, codes[o := np.argsort(who, kind="stable")], who[o]) for index, weight, codes, who in probes]
        while lo < right.num_rows:
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + HITS, "right")))
            cells = []
            for index, weight, codes, who in probes:
                some = slice(*np.searchsorted(who, (lo, hi)))
                owner, column = index.owners(codes[some], who[some])
                cells.append(((column - lo) * n + owner) * 2 + weight)
            cell = np.concatenate(cells)
            cell.sort()
            if len(cell):
                edge = np.flatnonzero(np.concatenate(([True], cell[1:] >> 1 != cell[:-1] >> 1)))
                shared = np.add.reduceat(cell & 1, edge)
                cell = cell[edge] >> 1
                l, r = cell % n, cell // n + lo
                shared = shared + self._common(bits, l, r)
                met = shared >= np.minimum(self.t[l], need[r])
                yield l[met], r[met], shared[met]
            lo = hi

    def _common(self, bits: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Frequent tokens that the sets of each pair share."""
        return sum(np.bitwise_count(own[l] & other[r]).astype(np.int64) for own, other in zip(self.bits, bits))


class _Index:
    """Tokens in order, each with the sets that hold it."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray):
        order = np.argsort(codes, kind="stable")
        codes, self.owner = codes[order], owner[order]
        self.codes, self.start = np.unique(codes, return_index=True)
        self.held = np.diff(np.append(self.start, len(codes)))

    def _find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.codes):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return at, self.codes[at] == codes

    def hits(self, codes: np.ndarray) -> np.ndarray:
        at, known = self._find(codes)
        return self.held[at] * known if len(self.held) else np.zeros(len(codes), np.int64)

    def owners(self, codes: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, column) of every set that holds one of the tokens."""
        at, known = self._find(codes)
        at, column = at[known], column[known]
        size, first = self.held[at], self.start[at]
        place = np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)
        return self.owner[place], np.repeat(column, size)


def _tokens(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All token hashes of an array of sets, and the position of the set of each."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), size)


def coded(sets: DataFrame, required: Required, *columns) -> DataFrame:
    """Rows as blocks take them: (id, t, codes, columns...) from ``sets(id, tokens, ...)``, written once."""
    codes = F.transform("tokens", lambda x: F.xxhash64(x))
    return cut_lineage(sets.select("id", required(F.size("tokens")).cast("int").alias("t"), codes.alias("codes"), *columns))


def _in_blocks(left: DataFrame, right: DataFrame, run: Callable[[_Block, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str,
               block: Callable[[list[pa.RecordBatch]], _Block] = _Block, most: int = BLOCK_SETS) -> DataFrame:
    """``run`` for every block of ``left`` with all rows of ``right``, ids ascending."""
    n = left.count()
    blocks = max(1, -(-n // most), min(left.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_SETS)))
    own = left.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), "*")
    other = right.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "*")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cut = int(np.searchsorted(batch.column("side").to_numpy(), 1))
                if cut:
                    held.append(batch.slice(0, cut))
                if cut < batch.num_rows:
                    yield batch.slice(cut)

        stream = rest(batches)
        first = next(stream, None)
        if held and first is not None:
            yield from run(block(held), (b for part in ((first,), stream) for b in part))

    dealt = own.unionByName(other, allowMissingColumns=True).repartitionById(blocks, F.col("block")).sortWithinPartitions("side", "id")
    return dealt.mapInArrow(task, schema)


def outlet_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, n): how many outlets the right sets have that each left set matches.

    Both sides are ``coded``; ``right`` has the array ``outlets`` of longs. A left set meets all right sets in one task, which
    keeps its outlets, not its pairs.
    """
    often = frequent(right)

    def run(block: _Block, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kept, new, held = {}, np.empty(0, np.int64), [], 0
        for batch in stream:
            lists = batch.column("outlets")
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            first = np.cumsum(size) - size
            outlet = np.array([names.setdefault(x, len(names)) for x in lists.flatten().to_pylist()], np.int64)
            for l, r, _ in block.meet(batch):
                n = size[r]
                place = np.arange(int(n.sum())) + np.repeat(first[r] - (np.cumsum(n) - n), n)
                # outlets are numbered as they come: the number is the high part, so that pairs stay as they are
                new.append(np.unique(outlet[place] * len(block.id) + np.repeat(l, n)))
                held += len(new[-1])
                if held > HITS + len(kept):
                    kept, new, held = np.unique(np.concatenate([kept, *new])), [], 0
        kept = np.unique(np.concatenate([kept, *new])) % len(block.id)
        n = np.bincount(kept, minlength=len(block.id))
        for at in range(0, len(n), 100_000):
            yield _batch(id=block.id[at:at + 100_000], n=n[at:at + 100_000])

    return _in_blocks(left, right, run, "id bigint, n bigint", lambda batches: _BitBlock(batches, often), WIDE_SETS)


def met_by(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id) of the right sets that match a left set; both sides are ``coded``."""
    often = frequent(right)

    def run(block: _Block, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            met = np.zeros(batch.num_rows, bool)
            for _, r, _ in block.meet(batch):
                met[r] = True
            yield _batch(id=batch.column("id").to_numpy()[met])

    return _in_blocks(left, right, run, "id bigint", lambda batches: _BitBlock(batches, often), WIDE_SETS).distinct()


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array(v) for n, v in columns.items()})


def all_matches(left: DataFrame, right: DataFrame, counts: bool = False) -> DataFrame:
    """(left_id, p, q, shared) of all pairs; with ``counts`` the left sets that each right row matches, (p, q, n).

    Both sides are ``coded``; ``right`` has the longs ``p`` and ``q``.
    """
    def pairs(block: _Block, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            p, q = (batch.column(c).to_numpy(zero_copy_only=False) for c in "pq")
            for l, r, shared in block.meet(batch):
                for at in range(0, len(l), 100_000):
                    some = slice(at, at + 100_000)
                    yield _batch(left_id=block.id[l[some]], p=p[r[some]], q=q[r[some]], shared=shared[some].astype(np.int32))

    def counted(block: _Block, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            n = np.zeros(batch.num_rows, np.int64)
            for _, r, _ in block.meet(batch):
                n += np.bincount(r, minlength=len(n))
            met = np.flatnonzero(n)
            yield _batch(p=batch.column("p").to_numpy(zero_copy_only=False)[met], q=batch.column("q").to_numpy(zero_copy_only=False)[met], n=n[met])

    if counts:
        return _in_blocks(left, right, counted, "p bigint, q bigint, n bigint").groupBy("p", "q").agg(F.sum("n").alias("n"))
    return _in_blocks(left, right, pairs, "left_id bigint, p bigint, q bigint, shared int")


def best_matches(left: DataFrame, right: DataFrame, top: int, apart: bool = False, each: int | None = None) -> DataFrame:
    """(left_id, other_id, shared): the ``top`` right rows of each left row by shared tokens, then by their id.

    Both sides are ``coded``. With ``apart`` both have the texts ``host`` and ``outlet``, and only rows that differ in both
    match; ``each`` then keeps that many rows of an outlet. A task keeps the best of each left row while the right rows
    pass by in the order of their ids: a later one must share more tokens than the last one kept.
    """
    def run(block: _Block, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, names = len(block.id), {}
        number = lambda texts: np.array([names.setdefault(x, len(names)) for x in texts.to_pylist()], np.int64)
        host, outlet = (number(block.columns.column(c)) if apart else None for c in ("host", "outlet"))
        best, ids, outs = np.zeros((n, top), np.int64), np.zeros((n, top), np.int64), np.zeros((n, top), np.int64)
        for batch in stream:
            other = batch.column("id").to_numpy()
            o_host, o_outlet = (number(batch.column(c)) if apart else None for c in ("host", "outlet"))
            for l, r, shared in block.meet(batch):
                good = shared > best[l, -1]
                if apart:
                    good &= (host[l] != o_host[r]) & (outlet[l] != o_outlet[r])
                l, r, shared = l[good], r[good], shared[good]
                if not len(l):
                    continue
                rows, old = np.unique(l), None
                old = np.repeat(rows, top)
                kept = best[rows].ravel() > 0
                a = np.concatenate([old[kept], l])
                s = np.concatenate([best[rows].ravel()[kept], shared])
                i = np.concatenate([ids[rows].ravel()[kept], other[r]])
                o = np.concatenate([outs[rows].ravel()[kept], o_outlet[r] if apart else np.zeros(len(r), np.int64)])
                if each:
                    order = np.lexsort((i, -s, o, a))
                    order = order[_rank(a[order], o[order]) < each]
                    a, s, i, o = a[order], s[order], i[order], o[order]
                order = np.lexsort((i, -s, a))
                a, s, i, o = a[order], s[order], i[order], o[order]
                rank = _rank(a)
                a, s, i, o, rank = (x[rank < top] for x in (a, s, i, o, rank))
                best[rows] = 0
                best[a, rank], ids[a, rank], outs[a, rank] = s, i, o
        for at in range(0, n, 10_000):
            l, k = np.nonzero(best[at:at + 10_000])
            yield _batch(left_id=block.id[l + at], other_id=ids[l + at, k], shared=best[l + at, k].astype(np.int32))

    return _in_blocks(left, right, run, "left_id bigint, other_id bigint, shared int")


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Place of each entry among its neighbours with equal keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(starts, np.diff(np.append(starts, len(new))))


def match_forest(sets: DataFrame) -> DataFrame:
    """(a, b): pairs of ``coded`` sets that meet the rule, enough of them to connect all that are connected by such pairs.

    A task joins the left sets that one right set meets; a right set gives one pair for each group of them that was not yet
    one. So a task returns fewer pairs than there are sets, however many pairs meet the rule.
    """
    def run(block: _Block, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up = np.arange(len(block.id))

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return int(x)

        for batch in stream:
            other = batch.column("id").to_numpy()
            for l, r, _ in block.meet(batch):
                half = block.id[l] < other[r]
                l, r = l[half], r[half]
                a, b = [], []
                # a few pairs at a time: what they join is one group for those that follow
                for at in range(0, len(l), 4096):
                    pair = np.unique(r[at:at + 4096] * len(up) + up[l[at:at + 4096]])
                    last, head, grew = -1, 0, False
                    for y, x in zip((pair // len(up)).tolist(), (pair % len(up)).tolist()):
                        x = root(x)
                        if y != last:
                            last, head = y, x
                        elif x != (head := root(head)):
                            up[max(x, head)], grew = min(x, head), True
                        else:
                            continue
                        a.append(x)
                        b.append(y)
                    while grew and (above := up[up]).tobytes() != up.tobytes():
                        up[:] = above
                if a:
                    yield _batch(a=block.id[a], b=other[b])

    return _in_blocks(sets, sets, run, "a bigint, b bigint")
