import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import Row

from gristmill.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = "ab  ▁\n\t'éßñ中文🙂\u0000­​　<s></s>THEthe0123.�\U0010ffff́"


def random_text(rng, n):
    return "".join(rng.choice(ODD) for _ in range(rng.randint(0, n)))


def test_ids_and_texts_equal_the_library():
    rng, own, library = random.Random(3), pieces.Vocabulary(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for _ in range(3000):
        text = random_text(rng, 80)
        ids = library.encode(text)
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids)
        loose = [rng.choice([rng.randrange(32000), rng.randrange(300)]) for _ in range(rng.randint(0, 12))]
        assert own.decode(loose) == library.decode(loose)


def test_list_and_heap_are_the_same_agenda():
    rng, own = random.Random(4), pieces.Vocabulary(PATH)
    for _ in range(500):
        text = "".join(rng.choice("aeiounrstlhd▁") for _ in range(rng.randint(0, 40)))
        assert own._merge_listed(list(text)) == own._merge_heaped(list(text))


def plain_merge(rank, symbols, frozen=()):
    """The first of the best pairs again and again, by looking at all pairs."""
    symbols = list(symbols)
    while True:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank and a not in frozen and b not in frozen), default=None)
        if best is None:
            return symbols
        symbols[best[1]:best[1] + 2] = ["".join(symbols[best[1]:best[1] + 2])]


def test_user_defined_and_unused_pieces():
    own = pieces.Vocabulary(PATH)
    own.own = frozenset({"<x>"})
    own.symbols = pieces.re.compile("<x>|.", pieces.re.DOTALL)
    assert own.merge("the<x>the") == plain_merge(own.rank, ["t", "h", "e", "<x>", "t", "h", "e"], {"<x>"})
    own = pieces.Vocabulary(PATH)
    assert own.merge("▁the") == ["▁the"]
    own.unused = frozenset({"▁the"})
    assert "".join(own.merge("▁the")) == "▁the" and "▁the" not in own.merge("▁the")


def test_long_texts_and_words(spark):
    words = ["thing " * 40_000, "ab" * 60_000, " " * 5_000, "\n".join(["x"] * 9_000)]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in pieces.tokenize(docs, PATH).collect():
        assert r.agrees and r.ids == library.encode(words[r.doc_id]) and r.decoded == words[r.doc_id]


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rows = [(1, None, 5, "x"), (1, "", 5, "x"), (2, "the end", 5, "x"), (2, "the end", 5, "x"), (None, " the  end ", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, agrees string")
    got = pieces.tokenize(docs, PATH).collect()
    assert sorted(got[0].asDict()) == ["agrees", "decoded", "doc_id", "ids", "text"]
    assert [len(r.ids) for r in got[:2]] == [0, 0] and [r.decoded for r in got] == ["", "", "the end", "the end", " the  end "]
    assert all(r.agrees is True for r in got) and got[2] == got[3]
    assert pieces.tokenize(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        pieces.tokenize(docs, PATH, text="ids")


def test_query_digests(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", "plain words here"] + [random_text(rng, 200) for _ in range(40)]
    spark.createDataFrame([Row(doc_id=i, text=t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.op13_sentencepiece(spark, str(tmp_path)).collect():
        ids = library.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.agrees) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)), True)
