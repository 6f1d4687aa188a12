"""Encoding and decoding with merge-type SentencePiece vocabularies.

A text is normalised and cut into symbols (user-defined pieces, else single characters). An agenda holds every adjacent
pair whose concatenation is a piece, best score first and leftmost first among equal scores; the best pair is merged and
its new neighbours enter the agenda, until nothing is left. Pieces marked unused are taken apart again, and what is no
piece becomes its bytes or the unknown id.

No merge can cross two neighbouring characters that no piece holds side by side. Texts are cut into words at such places
(before U+2581, between letters and marks), and the ids of words are remembered in a bounded table of each worker.
Vocabularies with user-defined pieces are encoded with one agenda for the whole text.

``tokenize`` runs in Arrow batches and compares ids and decoded texts with the library in the same batch.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty text; equal rows give
equal rows; all columns of the input are kept, and a result column replaces an input column of its name.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from gristmill.llm.common import SLICE_BYTES, small_batches

SPACE = "▁"
#: Words of each of the two generations that a worker remembers, and the length up to which it does.
REMEMBERED, REMEMBERED_CHARS = 700_000, 64
#: Symbols up to which the agenda is a list that is searched, which is faster than a heap for words.
LISTED = 40

# field numbers and values of the public model format
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE = 2


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one message of the model file."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            at += size
            yield key >> 3, message[at - size:at]


class Remembered(dict):
    """Ids of words, packed as 32-bit integers, in two generations: a full table becomes the older one."""

    def __init__(self, find: Callable[[str], bytes], limit: int = REMEMBERED):
        super().__init__()
        self.find, self.limit, self.before = find, limit, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        return self.remember(word, self.find(word) if ids is None else ids)

    def remember(self, word: str, ids: bytes) -> bytes:
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Vocabulary:
    """Pieces, scores and kinds of a merge-type model, read from its file; encodes and decodes like the library."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        trainer: dict[int, int | bytes] = {}
        spec: dict[int, int | bytes] = {}
        with open(path, "rb") as file:
            for field, value in _fields(file.read()):
                if field == TRAINER:
                    trainer = dict(_fields(value))
                elif field == NORMALIZER:
                    spec = dict(_fields(value))
                elif field == PIECES:
                    entry = dict(_fields(value))
                    piece, kind = entry[1].decode(), entry.get(3, NORMAL)
                    if kind in (NORMAL, USER_DEFINED, UNUSED):
                        self.ids[piece] = len(self.pieces)
                        self.rank[piece] = -struct.unpack("<f", entry.get(2, bytes(4)))[0]
                    self.pieces.append(piece)
                    self.kinds.append(kind)
        if trainer.get(3, 1) != MERGE_TYPE:
            raise ValueError(f"{path} is not a merge-type vocabulary")
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_text = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.strip = bool(spec.get(3, 1) or spec.get(4, 1))
        self.strip_all = bool(spec.get(4, 1))
        #: the normaliser only adds the leading space and writes spaces as U+2581
        self.simple = not spec.get(2) and bool(spec.get(3, 1)) and not spec.get(4, 1) and bool(spec.get(5, 1)) and not trainer.get(24)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE} if trainer.get(35) else {}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        #: the text of every id whose text does not depend on its neighbours, an ASCII byte included
        self.plain = [None if k in (UNKNOWN, CONTROL) or self.byte_of.get(i, 0) > 127 else p.replace(SPACE, " ") if k != BYTE else chr(int(p[3:5], 16))
                      for i, (p, k) in enumerate(zip(self.pieces, self.kinds))]
        own = sorted((p for p, k in zip(self.pieces, self.kinds) if k == USER_DEFINED), key=len, reverse=True)
        self.own = frozenset(own)
        self.unused = frozenset(p for p, k in zip(self.pieces, self.kinds) if k == UNUSED)
        self.symbols = re.compile("|".join([*map(re.escape, own), "."]), re.DOTALL)
        self.words = re.compile(".+" if own else self._chunks(), re.DOTALL)
        self.known = Remembered(self._word)

    def _chunks(self) -> str:
        """A pattern of the stretches of text that merges cannot leave.

        Two characters that stand side by side in some piece belong to one family, and so do those that a chain of such
        pairs ties; no piece spans two families. U+2581 would tie all of them, but where it only ever opens a piece it
        is taken out of the families and put in front of them.
        """
        up: dict[str, str] = {}

        def family(c: str) -> str:
            while up.setdefault(c, c) != c:
                up[c] = c = up[up[c]]
            return c

        pairs = {pair for piece in self.ids for pair in zip(piece, piece[1:])}
        opens = not any(y == SPACE and x != SPACE for x, y in pairs)
        for x, y in sorted(pairs):
            if not (opens and x == SPACE):
                up[family(x)] = family(y)
        families: dict[str, list[str]] = {}
        for c in sorted(up):
            families.setdefault(family(c), []).append(c)
        runs = [f"[{''.join(map(re.escape, members))}]+" for members in sorted(families.values(), key=len, reverse=True)]
        one = "|".join([*runs, f"[^{SPACE}]" if opens else "."])
        return f"{SPACE}*(?:{one})|{SPACE}+" if opens else one

    def merge(self, text: str) -> list[str]:
        """The pieces of ``text`` by merging adjacent symbols, best score first."""
        if len(text) <= LISTED and not self.own and not self.unused:
            return self._merge_listed(list(text))
        return self._merge_heaped(self.symbols.findall(text) if self.own else list(text))

    def _merge_listed(self, symbols: list[str]) -> list[str]:
        """The agenda as one score a pair, in text order; the first of the best scores is merged."""
        rank, never = self.rank.get, float("inf")
        agenda = [rank(x + y, never) for x, y in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) < never:
            i = agenda.index(best)
            del agenda[i]
            symbols[i] = joined = symbols[i] + symbols.pop(i + 1)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + joined, never)
            if i < len(agenda):
                agenda[i] = rank(joined + symbols[i + 1], never)
        return symbols

    def _merge_heaped(self, symbols: list[str]) -> list[str]:
        n, rank, own, unused = len(symbols), self.rank.get, self.own, self.unused
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        apart: dict[str, tuple[str, str]] = {}
        agenda = []
        for i, (x, y) in enumerate(zip(symbols, symbols[1:])):
            score = rank(x + y)
            if score is not None and not (own and (x in own or y in own)):
                agenda.append((score, i, i + 1, x + y))
                if unused and x + y in unused:
                    apart[x + y] = x, y
        heapq.heapify(agenda)
        while agenda:
            _, a, b, joined = heapq.heappop(agenda)
            x, y = symbols[a], symbols[b]
            # stale where one of the two symbols has been merged since
            if not x or not y or len(x) + len(y) != len(joined):
                continue
            symbols[a], symbols[b] = joined, ""
            after = right[a] = right[b]
            if after < n:
                left[after] = a
            for c, d in ((left[a], a), (a, after)):
                if c >= 0 and d < n:
                    x, y = symbols[c], symbols[d]
                    score = rank(x + y)
                    if score is not None and not (own and (x in own or y in own)):
                        heapq.heappush(agenda, (score, c, d, x + y))
                        if unused and x + y in unused:
                            apart[x + y] = x, y
        if not apart:
            return [s for s in symbols if s]
        out, todo = [], [s for s in reversed(symbols) if s]
        while todo:
            s = todo.pop()
            if s in apart:
                todo += reversed(apart[s])
            else:
                out.append(s)
        return out

    def _word(self, word: str) -> bytes:
        symbols = self.merge(word)
        try:
            return array("i", map(self.ids.__getitem__, symbols)).tobytes()
        except KeyError:  # a symbol that is no piece
            pass
        ids: list[int] = []
        for s in symbols:
            if s in self.ids:
                ids.append(self.ids[s])
            elif self.bytes:
                ids += [self.bytes[b] for b in s.encode("utf-8", "replace")]
            else:
                ids.append(self.unknown)
        return array("i", ids).tobytes()

    def normalize(self, text: str) -> str:
        return (text and SPACE + text.replace(" ", SPACE)) if self.simple else self.library.normalize(text)

    def encode_array(self, text: str) -> np.ndarray:
        """Ids of ``text`` without begin or end ids."""
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, self.words.findall(self.normalize(text)))), np.int32)
        if self.bytes or not len(ids):
            return ids
        unknown = ids == self.unknown
        return ids[~unknown | ~np.concatenate(([False], unknown[:-1]))]

    def encode(self, text: str) -> list[int]:
        return self.encode_array(text).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: control ids vanish, bytes that are no UTF-8 become U+FFFD, the leading space goes."""
        if ids and not self.strip_all:
            try:
                text = "".join(map(self.plain.__getitem__, ids))
            except TypeError:  # an id without a text of its own
                pass
            else:
                return text[1:] if self.strip and self.pieces[ids[0]].startswith(SPACE) else text
        out: list[str] = []
        run = bytearray()
        start = self.strip
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(run))
                run.clear()
                start = False
            if self.kinds[i] == CONTROL:
                continue
            if i == self.unknown:
                out.append(self.unknown_text)
                start = False
                continue
            piece = self.pieces[i]
            if start:
                if piece.startswith(SPACE):
                    piece = piece[1:]
                    start = self.strip_all
                if piece:
                    start = False
            out.append(piece.replace(SPACE, " "))
        if run:
            out.append(_utf8(run))
        return "".join(out)


def _utf8(run: bytearray) -> str:
    """Text of a run of byte pieces; every byte that is part of no character is one U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[at:at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary in ``path``, read once by each worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def text_slices(texts: list[str], limit: int = SLICE_BYTES) -> Iterator[list[str]]:
    """Runs of texts with about ``limit`` characters each, one text at least."""
    run: list[str] = []
    size = 0
    for text in texts:
        if run and size + len(text) > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def tokenize(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the text that they ``decoded`` to, and whether both ``agrees`` with the library."""
    small_batches(docs.sparkSession)
    added = [("ids", ArrayType(IntegerType(), False)), ("decoded", StringType()), ("agrees", BooleanType())]
    kept = [f for f in docs.schema.fields if f.name not in dict(added)]
    schema = StructType(kept + [StructField(n, t) for n, t in added])
    if text in dict(added):
        raise ValueError(f"the text column cannot be called {text}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            at = 0
            for texts in text_slices([t or "" for t in batch.column(text).to_pylist()]):
                arrays = [words.encode_array(t) for t in texts]
                ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)), type=pa.list_(pa.field("element", pa.int32(), False)))
                ids = [a.tolist() for a in arrays]
                decoded = [words.decode(i) for i in ids]
                theirs = words.library.encode(texts, num_threads=1)
                back = words.library.decode(theirs, num_threads=1)
                agrees = [a == b and c == d for a, b, c, d in zip(ids, theirs, decoded, back)]
                columns = [batch.column(f.name).slice(at, len(texts)) for f in kept]
                columns += [column, pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
