"""Alignment of two tokenizers' outputs on the same texts, with corpus-wide counts of aligned id pairs.

Each text is encoded once by a byte-level vocabulary (A) and a merge-type SentencePiece vocabulary (B) and written as
packed ids. Tokens are byte ranges of space + text. Byte offsets where both end cut the text into *groups*; an A and a B
token are *linked* where their ranges overlap. A pair's count is the number of documents that hold it linked.

The first pass aligns all documents and collects the distinct pairs of each task. Pairs are dealt to a fixed number of
shards by a mixed key, united there in a tree of merges, and each shard gets a minimal perfect hash. Counts are dense
vectors indexed by it: each group of tasks adds up its own, and the vectors are summed in a tree of bounded fan-in. The
second pass aligns the documents again and looks their pairs up, verifying the key that stands under each number.

A shard holds at most (ids of A x ids of B) / ``SHARDS`` pairs. The finished table is broadcast while its counted pairs
stay under ``BROADCAST_PAIRS``; beyond that the pairs of each document travel to the shards, in salted groups, instead.

Defined results: texts that are null or empty, or whose tokens of A or B do not join to exactly space + text, have no
tokens and links; every row counts as a document of its own, repeated ids and texts included; a null id stays null;
columns other than id and text are ignored; an empty table gives empty results.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut, shared_folder, small_batches
from gristmill.llm.hashing import mix
from gristmill.llm.perfect_hash import PerfectHash
from gristmill.llm.pieces import BYTE, SPACE, Remembered, Vocabulary, text_slices

SHARDS = 64
#: Words of each generation that a worker remembers for either vocabulary.
REMEMBERED = 400_000
#: Vectors or key lists that one task adds up.
FAN_IN = 64
#: Pairs up to which the table is broadcast; 12 bytes a pair and 4 bits of hash keep it under 100 MB.
BROADCAST_PAIRS = 8_000_000
#: Distinct pairs that a task of the first pass holds before it passes them on.
HELD_PAIRS = 4_000_000
#: Bytes of tokens that are aligned at a time.
ALIGNED_BYTES = 2 << 20
#: Bytes of tokens whose pairs meet one shard in one group, where the table is not broadcast.
SALT_BYTES = 16 << 20

# the public pattern of words of the byte-level vocabulary, for texts of characters on which all Unicode versions agree
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_PLAIN = re.compile("[\t\n\r -~¡«»¿À-ÖØ-öø-ɏΑ-ΡΣ-Ωα-ωА-я–—‘’“”„•…、。ぁ-ゖァ-ヺ一-鿿가-힣]*")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteVocabulary:
    """A byte-level vocabulary with the bytes of its ids; the library encodes every word once, whose ids are remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.model = self.library.model
        letters, vocab = _byte_letters(), self.library.get_vocab(with_added_tokens=True)
        self.letter = [c for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.size = max(vocab.values()) + 1
        self.token = [b""] * self.size
        for token, i in vocab.items():
            self.token[i] = token.encode() if token in special else bytes(map(letters.__getitem__, token))
        self.lengths = np.array([len(t) for t in self.token], np.int64)
        before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        # words can be told by the pattern only if the file asks for just that
        self.by_words = not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not model.get("dropout")
        self.known = Remembered(self._word, REMEMBERED)

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32).tobytes()

    def _word(self, word: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize("".join(map(self.letter.__getitem__, word.encode())))], np.int32).tobytes()

    def encode_array(self, text: str) -> np.ndarray:
        if self.by_words and _PLAIN.fullmatch(text):
            return np.frombuffer(b"".join(map(self.known.__getitem__, _WORDS.findall(text))), np.int32)
        return np.frombuffer(self._ids(text), np.int32)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


class Tokenizers:
    """Both vocabularies and the byte lengths of their ids."""

    def __init__(self, first: str, second: str):
        self.a, self.b = ByteVocabulary(first), Vocabulary(second)
        self.b.known.limit = REMEMBERED
        self.b_token = [bytes([self.b.byte_of[i]]) if k == BYTE else p.replace(SPACE, " ").encode() for i, (p, k) in enumerate(zip(self.b.pieces, self.b.kinds))]
        self.b_lengths = np.array([len(t) for t in self.b_token], np.int64)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B of each text, none where the tokens do not join to space + text."""
        out, none = [], np.empty(0, np.int32)
        full = [" " + t if t else "" for t in texts]
        for text in full:
            a = self.a.encode_array(text) if text else none
            b = self.b.encode_array(text[1:]) if text else none
            want = text.encode("utf-8", "replace")
            same = self.a.joined(a) == want and b"".join(map(self.b_token.__getitem__, b.tolist())) == want
            out.append((a, b) if same else (none, none))
        return out


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(first: str, second: str) -> Tokenizers:
    if (first, second) not in _LOADED:
        _LOADED[first, second] = Tokenizers(first, second)
    return _LOADED[first, second]


class Aligned:
    """The alignment of some documents, as arrays over all of their links.

    ``doc``, ``a``, ``b``: document, A id and B id of each link in byte order; ``both``: whether both tokens end there.
    """

    def __init__(self, ids: list[tuple[np.ndarray, np.ndarray]], a_lengths: np.ndarray, b_lengths: np.ndarray):
        self.n = len(ids)
        self.n_a, self.n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
        self.a_ids, self.b_ids = (np.concatenate([x[k] for x in ids]).astype(np.int64) if ids else np.empty(0, np.int64) for k in (0, 1))
        # ends over the joined bytes of all documents, which both sides cover alike
        a_ends, b_ends = np.cumsum(a_lengths[self.a_ids]), np.cumsum(b_lengths[self.b_ids])
        size = int(a_ends[-1]) if len(a_ends) else 0
        end = np.zeros(size + 1, np.int8)
        end[a_ends] = 1
        end[b_ends] += 2
        ends = np.flatnonzero(end)
        kind = end[ends]
        # each stretch between neighbouring ends lies in one token of either side
        at_a, at_b = np.cumsum(kind & 1) - (kind & 1), np.cumsum(kind >> 1) - (kind >> 1)
        self.both = kind == 3
        self.at_a, self.at_b = at_a, at_b
        self.a, self.b = self.a_ids[at_a], self.b_ids[at_b]
        self.doc = np.repeat(np.arange(self.n), self.n_a)[at_a]

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=values, minlength=self.n).astype(np.int64) if len(self.doc) else np.zeros(self.n, np.int64)

    def doc_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, key of the pair, links) once for each document and pair."""
        key = (self.doc << 32) | _key(self.a, self.b)
        key.sort()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        return key[first] >> 32, key[first] & 0xFFFFFFFF, np.diff(np.append(first, len(key)))

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        ends = np.flatnonzero(self.both)
        last_a, last_b = self.at_a[ends], self.at_b[ends]
        # what follows a token: more of its side, the other side, the next group or the end of the document
        tail_a, tail_b = np.zeros(len(self.a_ids), np.int64), np.zeros(len(self.b_ids), np.int64)
        tail_a[last_a], tail_b[last_b] = 1, 2
        group_a, group_b = np.cumsum(tail_a == 1) - (tail_a == 1), np.cumsum(tail_b == 2) - (tail_b == 2)
        tail_b[np.cumsum(self.n_b)[self.n_b > 0] - 1] = 3
        parts = np.empty(len(self.a_ids) + len(self.b_ids), np.int64)
        parts[np.arange(len(self.a_ids)) + np.concatenate(([0], last_b + 1))[group_a]] = self.a_ids + (tail_a << 16)
        parts[np.arange(len(self.b_ids)) + (last_a + 1)[group_b]] = self.b_ids + (tail_b << 16)
        texts = iter("".join(map(_printed().__getitem__, parts.tolist())).split("\n"))
        return [next(texts) if n else "" for n in self.n_a.tolist()]


@lru_cache(1)
def _printed() -> list[str]:
    """Every id with every tail."""
    return [f"{i}{tail}" for tail in ",|;\n" for i in range(1 << 16)]


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << 16) | b


def _shard(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(SHARDS)).astype(np.int64)


def _unpacked(rows: list[tuple[bytes, bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)) for a, b in rows]


def _aligned_runs(batches: Iterator[pa.RecordBatch], lengths) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    """Batches of packed ids in runs of bounded size, with their alignment."""
    a_lengths, b_lengths = lengths.value
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        at = 0
        while at < len(a):
            to, size = at + 1, len(a[at])
            while to < len(a) and size + len(a[to]) <= ALIGNED_BYTES:
                size += len(a[to])
                to += 1
            yield batch.slice(at, to - at), Aligned(_unpacked(list(zip(a[at:to], b[at:to]))), a_lengths, b_lengths)
            at = to


def encode(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, a, b): packed 16-bit ids of every row, written to the shared folder; ``row`` is unique."""
    small_batches(docs.sparkSession)
    both = tokenizers(first, second)
    if max(both.a.size, len(both.b.pieces)) > 1 << 16:
        raise ValueError("vocabularies of more than 65,536 ids are not packed")
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(first, second)
        for batch in batches:
            at = 0
            for texts in text_slices([t or "" for t in batch.column(1).to_pylist()]):
                ids = both.encode(texts)
                packed = [pa.array([x[k].astype(np.uint16).tobytes() for x in ids], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *packed], ["doc_id", "a", "b"])
                at += len(texts)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, a binary, b binary")
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex[:12]}"
    rows.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def _united(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def task_pairs(tokens: DataFrame, lengths) -> DataFrame:
    """(shard, part, keys, counts): the distinct pairs of each task's documents and in how many of these they are linked."""

    def packed(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        shard = _shard(keys)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(SHARDS + 1))
        rows = [(s, keys[order[lo:hi]].tobytes(), counts[order[lo:hi]].tobytes()) for s, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, fresh, held = [], [], 0, 0
        for _, found in _aligned_runs(batches, lengths):
            key = np.sort(found.doc_pairs()[1])
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
            keys.append(key[first])
            counts.append(np.diff(np.append(first, len(key))))
            fresh += len(first)
            if fresh > max(held, 500_000):
                one = _united(keys, counts)
                keys, counts, fresh, held = [one[0]], [one[1]], 0, len(one[0])
                if held > HELD_PAIRS:
                    yield packed(*one)
                    keys, counts, held = [], [], 0
        if keys:
            yield packed(*_united(keys, counts))

    return tokens.select("a", "b").mapInArrow(run, "shard int, keys binary, counts binary").withColumn("part", F.spark_partition_id())


def _int64(values) -> list[np.ndarray]:
    return [np.frombuffer(v, np.int64) for v in values]


def _unite(pdf: pd.DataFrame) -> pd.DataFrame:
    keys, _ = _united(_int64(pdf["keys"]), [np.zeros(len(v) // 8, np.int64) for v in pdf["keys"]])
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1].to_numpy(), "part": pdf["group"].iloc[:1].to_numpy(), "keys": [keys.tobytes()]})


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = None
    for v in pdf["counts"]:
        v = np.frombuffer(v, np.int64)
        total = v.copy() if total is None else np.add(total, v, out=total)
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1].to_numpy(), "part": pdf["group"].iloc[:1].to_numpy(), "counts": [total.tobytes()]})


def _hash(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = np.frombuffer(pdf["keys"].iloc[0], np.int64)
    found = PerfectHash.build(keys)
    placed = np.empty(len(keys), np.int64)
    placed[found.numbers(keys)] = keys
    return pd.DataFrame({"shard": pdf["shard"].to_numpy(), "n": [len(keys)], "keys": [placed.astype(np.uint32).tobytes()], "hash": [found.to_bytes()]})


def _dense(parts: pd.DataFrame, hashes: pd.DataFrame) -> pd.DataFrame:
    """One vector of the counts of a group of tasks, indexed by the shard's hash."""
    found, n = PerfectHash.from_bytes(hashes["hash"].iloc[0]), int(hashes["n"].iloc[0])
    stands = np.frombuffer(hashes["keys"].iloc[0], np.uint32)
    total = np.zeros(n, np.int64)
    for keys, counts in zip(_int64(parts["keys"]), _int64(parts["counts"])):
        number = found.numbers(keys)
        if not (stands[number] == keys).all():
            raise ValueError("a pair is missing from the hash of its shard")
        total[number] += counts  # the keys of a part are distinct
    return pd.DataFrame({"shard": hashes["shard"].iloc[:1].to_numpy(), "part": hashes["group"].iloc[:1].to_numpy(), "counts": [total.tobytes()]})


def pair_table(tokens: DataFrame, lengths) -> DataFrame:
    """(shard, n, keys, hash, counts): the distinct pairs of a shard in the order of its hash, and their counts.

    One row a shard, of bounded size; the sizes of all trees follow from the number of tasks that sent parts.
    """
    folder = f"{shared_folder(tokens.sparkSession)}/pairs-{uuid.uuid4().hex[:12]}"
    task_pairs(tokens, lengths).write.parquet(folder)
    parts = tokens.sparkSession.read.parquet(folder)
    n = (parts.agg(F.max("part")).first()[0] or 0) + 1
    group = lambda n: (F.col("part") % max(1, -(-n // FAN_IN))).cast("int").alias("group")
    keys, left = parts.select("shard", "part", "keys"), n
    while True:
        keys = keys.select("shard", "keys", group(left)).groupBy("shard", "group").applyInPandas(_unite, "shard int, part int, keys binary")
        left = -(-left // FAN_IN)
        if left == 1:
            break
    hashes = cut(keys.select("shard", "keys").groupBy("shard").applyInPandas(_hash, "shard int, n long, keys binary, hash binary"))
    groups = max(1, -(-n // FAN_IN))
    copies = hashes.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    counts = parts.select("shard", "keys", "counts", group(n)).groupBy("shard", "group").cogroup(copies.groupBy("shard", "group"))
    counts = counts.applyInPandas(_dense, "shard int, part int, counts binary")
    while groups > 1:
        counts = counts.select("shard", "counts", group(groups)).groupBy("shard", "group").applyInPandas(_add, "shard int, part int, counts binary")
        groups = -(-groups // FAN_IN)
    return cut(hashes.join(counts.select("shard", "counts"), "shard"))


def pair_counts(table: DataFrame) -> DataFrame:
    """(a_id, b_id, n_docs) of every pair that is linked anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, counts = np.frombuffer(keys, np.uint32), np.frombuffer(counts, np.int64)
                for at in range(0, len(keys), 100_000):
                    k = keys[at:at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array((k >> 16).astype(np.int32)), pa.array((k & 0xFFFF).astype(np.int32)), pa.array(counts[at:at + 100_000])], ["a_id", "b_id", "n_docs"])

    return table.select("keys", "counts").mapInArrow(run, "a_id int, b_id int, n_docs long")


class Lookup:
    """Counts of pairs by hash and verified key, over all shards."""

    def __init__(self, rows: list[tuple[int, bytes, bytes, bytes]]):
        self.shards = {s: (PerfectHash.from_bytes(h), np.frombuffer(k, np.uint32), np.frombuffer(c, np.int64)) for s, k, h, c in rows}

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of ``keys``, 0 for a key that is in no shard."""
        out = np.zeros(len(keys), np.int64)
        shard = _shard(keys)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(SHARDS + 1))
        for s, (found, stands, counts) in self.shards.items():
            own = order[cuts[s]:cuts[s + 1]]
            if len(own):
                number = found.numbers(keys[own])
                known = (number >= 0) & (number < len(stands))
                known[known] = stands[number[known]] == keys[own][known]
                out[own[known]] = counts[number[known]]
        return out


_RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _facts(found: Aligned) -> list[pa.Array]:
    return [pa.array(found.n_a), pa.array(found.n_b), pa.array(found.per_doc(found.both)), pa.array(np.bincount(found.doc, minlength=found.n).astype(np.int64))]


def _best(table: DataFrame) -> np.ndarray:
    """The highest count of every A id; at most 65,536 numbers."""
    best = np.zeros(1 << 16, np.int64)
    for a, n in pair_counts(table).groupBy("a_id").agg(F.max("n_docs")).collect():
        best[a] = n
    return best


def align(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every document.

    ``n_best``: links whose count is the highest of their A id; ``count_sum``: the sum of the counts of all links.
    """
    spark = docs.sparkSession
    both = tokenizers(first, second)
    lengths = spark.sparkContext.broadcast((both.a.lengths, both.b_lengths))
    tokens = encode(docs, first, second, doc_id, text)
    table = pair_table(tokens, lengths)
    best = spark.sparkContext.broadcast(_best(table))
    kind = tokens.schema["doc_id"].dataType.simpleString()
    pairs = table.agg(F.sum("n")).first()[0] or 0
    if pairs > BROADCAST_PAIRS:
        return _by_shards(tokens, table, lengths, best, kind)
    lookup = spark.sparkContext.broadcast(Lookup([(r["shard"], r["keys"], r["hash"], r["counts"]) for r in table.collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best_of = lookup.value, best.value
        for batch, found in _aligned_runs(batches, lengths):
            doc, key, links = found.doc_pairs()
            count = known.counts(key)
            top = np.bincount(doc, weights=links * (count == best_of[key >> 16]), minlength=found.n).astype(np.int64)
            total = np.zeros(found.n, np.int64)
            np.add.at(total, doc, links * count)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_facts(found), pa.array(top), pa.array(total), pa.array(found.groups(), pa.string())], ["doc_id", *(c.split(" ")[0] for c in _RESULT.split(", "))])

    return tokens.select("doc_id", "a", "b").mapInArrow(run, f"doc_id {kind}, {_RESULT}")


def _by_shards(tokens: DataFrame, table: DataFrame, lengths, best, kind: str) -> DataFrame:
    """The second pass for tables that are too large to broadcast: pairs meet their shard in salted groups."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _aligned_runs(batches, lengths):
            rows = np.array(batch.column("row").to_pylist(), np.int64)
            doc, key, links = found.doc_pairs()
            shard = _shard(key)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(SHARDS + 1))
            out = [(s, rows[doc[o]].tobytes(), key[o].tobytes(), links[o].tobytes()) for s in range(SHARDS) if len(o := order[cuts[s]:cuts[s + 1]])]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.binary()) for k in (1, 2, 3))], ["shard", "rows", "keys", "links"])

    def meet(sent: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        if not len(sent):
            return pd.DataFrame({"row": [], "n_best": [], "count_sum": []})
        known = Lookup([(r.shard, r.keys, r.hash, r.counts) for r in shards.itertuples()])
        rows, key, links = (np.concatenate(_int64(sent[c])) for c in ("rows", "keys", "links"))
        count = known.counts(key)
        row, at = np.unique(rows, return_inverse=True)
        top, total = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        np.add.at(top, at, links * (count == best.value[key >> 16]))
        np.add.at(total, at, links * count)
        return pd.DataFrame({"row": row, "n_best": top, "count_sum": total})

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _aligned_runs(batches, lengths):
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *_facts(found), pa.array(found.groups(), pa.string())], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])

    size = tokens.agg(F.sum(F.length("a") + F.length("b"))).first()[0] or 0
    salts = int(size // (SHARDS * SALT_BYTES)) + 1
    sent = tokens.select("row", "a", "b").mapInArrow(send, "shard int, rows binary, keys binary, links binary").withColumn("salt", F.pmod(F.xxhash64("rows"), F.lit(salts)).cast("int"))
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sums = sent.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(meet, "row long, n_best long, count_sum long")
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    facts = tokens.select("row", "doc_id", "a", "b").mapInArrow(rest, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string")
    return facts.join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"]).select("doc_id", *(c.split(" ")[0] for c in _RESULT.split(", ")))
