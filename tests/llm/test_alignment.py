import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gristmill.llm import alignment, queries
from gristmill.llm.perfect_hash import PerfectHash

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = "ab  \n\t'éßñ中文🙂\u0000­​　THEthe0123.²½_ª\x1c\x85\xa0’"


def brute(rows):
    """All overlapping token pairs by comparing byte ranges, straight from the two libraries."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    letter = {c: b for c, b in alignment._byte_letters().items()}
    docs = []
    for doc_id, text in rows:
        tokens = ([], [])
        if text:
            a = first.encode(" " + text, add_special_tokens=False).ids
            tokens_a = [(i, len(bytes(letter[c] for c in first.id_to_token(i)))) for i in a]
            joined_a = b"".join(bytes(letter[c] for c in first.id_to_token(i)) for i in a)
            pieces = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i in second.encode(text) for p in [second.id_to_piece(i)]]
            if joined_a == (" " + text).encode() == b"".join(p for _, p in pieces):
                tokens = tokens_a, [(i, len(p)) for i, p in pieces]
        spans = []
        for side in tokens:
            at, out = 0, []
            for i, n in side:
                out.append((i, at, at + n))
                at += n
            spans.append(out)
        links = [(x, y) for x, xs, xe in spans[0] for y, ys, ye in spans[1] if max(xs, ys) < min(xe, ye)]
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = ";".join("|".join(",".join(str(i) for i, s, e in side if lo < e <= hi) for side in spans) for lo, hi in zip([0, *cuts], cuts))
        docs.append((doc_id, len(spans[0]), len(spans[1]), len(cuts), links, groups))
    count = Counter(p for d in docs for p in set(d[4]))
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    rows = [(d[0], d[1], d[2], d[3], len(d[4]), sum(count[p] == best[p[0]] for p in d[4]), sum(count[p] for p in d[4]), hashlib.sha256(d[5].encode()).hexdigest() if d[1] else "") for d in docs]
    return rows, count


def texts():
    rng = random.Random(8)
    words = ["the", "nation", "thheingble", "Über", "l'été", "don't", "x\n\ny", "  ", "$$$", "1234", "naïve", "日本", "🙂"]
    odd = ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 60))) for _ in range(25)]
    plain = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    return [None, "", "a ▁ b", "<|endoftext|> <s>", " lead", *odd, *plain, plain[0], plain[0]]


def test_query_equals_brute_force_whatever_the_size(spark, tmp_path, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "again"), (None, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    want, _ = brute(rows)
    assert len({r[1] for r in want}) > 5
    got = queries.op12_token_alignment(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    # small trees, small runs, tables that are not broadcast
    for name, value in (("FAN_IN", 2), ("ALIGNED_BYTES", 300), ("HELD_PAIRS", 50), ("BROADCAST_PAIRS", 0), ("SALT_BYTES", 10)):
        monkeypatch.setattr(alignment, name, value)
    got = queries.op12_token_alignment(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_pair_counts_and_long_texts(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    both = alignment.tokenizers(A, B)
    lengths = spark.sparkContext.broadcast((both.a.lengths, both.b_lengths))
    table = alignment.pair_table(alignment.encode(docs, A, B), lengths)
    assert {(r.a_id, r.b_id): r.n_docs for r in alignment.pair_counts(table).collect()} == dict(brute(rows)[1])
    long = spark.createDataFrame([(1, "thing and nation " * 40_000), (2, "ab" * 30_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.align(long, A, B).collect()}
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups and r.n_a and r.groups.count(";") == r.n_groups - 1 for r in got.values())


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([("k", "some words", 1, "x")], "doc_id string, text string, row int, a string")
    assert [r.doc_id for r in alignment.align(docs, A, B).collect()] == ["k"]
    assert alignment.align(docs.limit(0), A, B).count() == 0
    assert alignment.align(docs.withColumn("text", F.lit(None).cast("string")), A, B).first().n_links == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**40, n))
    found = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(found.numbers(keys).tolist()) == list(range(len(keys)))
    others = found.numbers(np.arange(2**41, 2**41 + 100))
    assert ((others >= -1) & (others < max(1, len(keys)))).all()
