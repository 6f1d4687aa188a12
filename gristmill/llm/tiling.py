"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters and digits. Running Karp-Rabin hashes of ``min_tile`` words are the seeds that a
document and a benchmark item must share. For each such pair the longest common run of unmarked words is marked again
and again (*tiles*), until none of ``min_tile`` words is left. The item is *covered* by the share of its words inside
tiles, so passages whose sentences were reordered or pulled apart count as well as passages in one piece.

The benchmark is the stated query set: it is cut into blocks of bounded size, and each block's seeds are broadcast to one
scan of the documents. The documents are never shuffled, and a passage that stands in every document is no hot key.

Defined results: a null or blank text matches nothing; an item with fewer than ``min_tile`` words cannot be tested and
matches nothing; a repeated document or item gives repeated rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import slices, small_batches
from gristmill.llm.hashing import ngrams, word_hashes

#: Characters of benchmark text whose seeds are broadcast at a time.
BLOCK_CHARS = 4_000_000
#: Shared places of a document and an item that are looked at together.
HITS = 1_000_000
_GAP = re.compile(r"[\W_]+")
_BITS = 22


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([_GAP.sub(" ", (t or "").lower()) for t in texts])


class Seeds:
    """Hashes of all runs of ``k`` words of a block of items, with the places where they stand."""

    def __init__(self, items: list[tuple], k: int):
        self.k, self.ids = k, [i for i, _ in items]
        words, at = words_of([t for _, t in items])
        self.words = [words[at[i]:at[i + 1]] for i in range(len(items))]
        runs = [ngrams(w, k) if len(w) >= k else np.empty(0, np.uint64) for w in self.words]
        hashes = np.concatenate(runs) if runs else np.empty(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.arange(len(runs)), [len(r) for r in runs])[order]
        self.place = np.concatenate([np.arange(len(r)) for r in runs])[order] if runs else order
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.hashes >> np.uint64(64 - _BITS)] = True

    def met(self, runs: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(item, its places) of the seeds of a document, each place once however often the document repeats the seed."""
        found = np.unique(runs[self.bits[runs >> np.uint64(64 - _BITS)]])
        lo, hi = np.searchsorted(self.hashes, found, "left"), np.searchsorted(self.hashes, found, "right")
        n = hi - lo
        rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((self.place[rows], self.item[rows]))
        item, place = self.item[rows][order], self.place[rows][order]
        cuts = np.flatnonzero(np.diff(item)) + 1
        return [(int(i[0]), p) for i, p in zip(np.split(item, cuts), np.split(place, cuts)) if len(i)]


class _Prefix:
    """Hashes of runs of any length from one pass: sums of word hashes times falling powers of an odd number."""

    _STEP = np.uint64(0x9E3779B97F4A7C15)
    _BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def __init__(self, words: np.ndarray):
        def powers(step: np.uint64) -> np.ndarray:
            out = np.full(len(words) + 1, step, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        self.up = powers(self._STEP)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers(self._BACK)[:-1], dtype=np.uint64)))

    def of(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.up[at]


def _free_ahead(used: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many unmarked words follow each place, itself included, inside its stretch."""
    n = len(used)
    stop = np.where(used, np.arange(n), n)
    return np.minimum(np.minimum.accumulate(stop[::-1])[::-1], ends) - np.arange(n)


def tile(doc: np.ndarray, item: np.ndarray, k: int, ends: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in the document, place in the item), the longest first and at least ``k`` words long.

    Matches are searched for by running hashes of a length that is halved down to ``k``, among unmarked words only: what
    is shorter than the present length waits for a later search. So the matches held at a time are those of one length
    class, and a repetitive document does not hold all pairs of its places. ``ends`` says for each place of ``doc`` where
    its stretch ends, which no match may cross.
    """
    ends = np.full(len(doc), len(doc)) if ends is None else ends
    item_ends = np.full(len(item), len(item))
    used_doc, used_item, tiles = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    doc_hash, item_hash = _Prefix(doc), _Prefix(item)
    size = min(len(doc), len(item))
    while size >= k and not used_item.all():
        ahead_doc, ahead_item = _free_ahead(used_doc, ends), _free_ahead(used_item, item_ends)
        size = max(k, min(size, int(ahead_doc.max(initial=0)), int(ahead_item.max(initial=0))))
        heap = list(zip(*_runs(doc, item, doc_hash, item_hash, ahead_doc, ahead_item, size, ends)))
        heapq.heapify(heap)
        while heap:
            n, b, a = heapq.heappop(heap)
            free = ~(used_doc[a:a - n] | used_item[b:b - n]) & (doc[a:a - n] == item[b:b - n])
            if free.all():
                used_doc[a:a - n] = used_item[b:b - n] = True
                tiles.append((-n, a, b))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([False], free, [False])).astype(np.int8)))
            for lo, hi in zip(edge[0::2].tolist(), edge[1::2].tolist()):
                if hi - lo >= size:
                    heapq.heappush(heap, (lo - hi, b + lo, a + lo))
        if size == k:
            break
        size = max(k, size // 2)
    return tiles


def _runs(doc, item, doc_hash, item_hash, ahead_doc, ahead_item, size, ends) -> tuple[list[int], list[int], list[int]]:
    """(minus length, place in the item, place in the document) of the longest matches of ``size`` words or more."""
    p_all, q_all = np.flatnonzero(ahead_doc >= size), np.flatnonzero(ahead_item >= size)
    order = np.argsort(item_hash.of(q_all, size), kind="stable")
    seeds = item_hash.of(q_all, size)[order]
    wanted = doc_hash.of(p_all, size)
    lo, hi = np.searchsorted(seeds, wanted, "left"), np.searchsorted(seeds, wanted, "right")
    some = hi > lo
    p_all, lo, hi = p_all[some], lo[some], hi[some]
    total = np.cumsum(hi - lo)
    out: tuple[list[int], list[int], list[int]] = [], [], []
    at = 0
    while at < len(p_all):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HITS, "right")))
        n = hi[at:to] - lo[at:to]
        p = np.repeat(p_all[at:to], n)
        q = q_all[order[np.repeat(lo[at:to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]]
        # only where a match cannot begin a word earlier
        before = (p > 0) & (q > 0)
        before[before] = (ahead_doc[p[before] - 1] > size) & (ahead_item[q[before] - 1] > size) & (doc[p[before] - 1] == item[q[before] - 1])
        p, q = p[~before], q[~before]
        low, high = np.full(len(p), size), np.minimum(ahead_doc[p], ahead_item[q])
        while (low < high).any():
            half = (low + high + 1) // 2
            same = doc_hash.of(p, half) == item_hash.of(q, half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        for part, values in zip(out, (-low, q, p)):
            part += values.tolist()
        at = to
    return out


def matches(seeds: Seeds, words: np.ndarray, threshold: float) -> Iterator[tuple[object, int, int, int]]:
    """(item id, words of the item, tiles, words covered) of the items that a document covers to the threshold."""
    k = seeds.k
    if len(words) < k:
        return
    runs = ngrams(words, k)
    places = None
    for i, q in seeds.met(runs):
        of = seeds.words[i]
        # an upper bound first: words of the item under any seed at all
        under = np.zeros(len(of) + 1, np.int64)
        np.add.at(under, q, 1)
        np.add.at(under, q + k, -1)
        if (np.cumsum(under)[:-1] > 0).sum() < threshold * len(of):
            continue
        if places is None:
            places = np.argsort(runs, kind="stable")
            ordered = runs[places]
        # the document's words under a seed of this item, in stretches
        own = np.unique(ngrams(of, k))
        lo, hi = np.searchsorted(ordered, own, "left"), np.searchsorted(ordered, own, "right")
        n = hi - lo
        p = places[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        near = np.zeros(len(words) + 1, np.int64)
        np.add.at(near, p, 1)
        np.add.at(near, p + k, -1)
        near = np.flatnonzero(np.cumsum(near)[:-1] > 0)
        breaks = np.append(np.flatnonzero(np.diff(near) > 1) + 1, len(near))
        ends = breaks[np.searchsorted(breaks, np.arange(len(near)), "right")]
        tiles = tile(words[near], of, k, ends)
        covered = sum(t[0] for t in tiles)
        if covered >= threshold * len(of):
            yield seeds.ids[i], len(of), len(tiles), covered


def _blocks(docs: DataFrame, benchmark: DataFrame, min_tile: int):
    """Broadcast seeds of one block of the benchmark after the other."""
    small_batches(docs.sparkSession)
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL")
    blocks = 1 + int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        if block:
            yield docs.sparkSession.sparkContext.broadcast(Seeds([(r[0], r[1]) for r in block], min_tile))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_tile: int = 5, threshold: float = 0.6) -> DataFrame:
    """(doc_id, item_id, item_words, tiles, covered, coverage): the benchmark items that documents contain."""
    kinds = [f.dataType.simpleString() for f in (docs.schema["doc_id"], benchmark.schema["item_id"])]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, item_words int, tiles int, covered int, coverage double"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    out = docs.sparkSession.createDataFrame([], schema)
    for seeds in _blocks(docs, benchmark, min_tile):
        def run(batches: Iterator[pd.DataFrame], seeds=seeds) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for pdf in slices(batch):
                    words, at = words_of(pdf["text"].tolist())
                    ids = pdf["doc_id"].tolist()
                    rows = [(ids[i], *m, m[3] / m[1]) for i in range(len(ids)) for m in matches(seeds.value, words[at[i]:at[i + 1]], threshold)]
                    yield pd.DataFrame(rows, columns=names)

        out = out.unionByName(docs.select("doc_id", "text").mapInPandas(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_tile: int = 5, threshold: float = 0.6) -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item to the threshold, all columns as they were."""
    for seeds in _blocks(docs, benchmark, min_tile):
        def run(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for pdf in slices(pd.DataFrame({"text": batch.column("text").to_pylist()}, dtype=object)):
                    words, at = words_of(pdf["text"].tolist())
                    keep += [next(matches(seeds.value, words[at[i]:at[i + 1]], threshold), None) is None for i in range(len(pdf))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
