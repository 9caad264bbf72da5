"""Token counts and pieces against the libraries themselves."""

import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
WORD, PIECE = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
LETTERS = "aàÀeßΣσİıſK'´`12٣½²Ⅷ̧́    \x1c\x85\t\n.,;-_<|>▁▁  日本語한국어ﬁ👍🏽éͅǅ\x00﻿"
FIXED = ["a<|endoftext|>b", "<|startoftext|><|endoftext|>", " <|endoftext|> x", "<|EndOfText|>", "it's we'll I'M", "", " ", "  ", "▁", "▁▁ a", "      the  cat", " " * 40 + "x" + " " * 17, "x" * 3000, "ab" * 2000, "a" * 5000 + "b"]


def texts(n=400):
    draw = random.Random(1)
    return ["".join(draw.choices(LETTERS, k=draw.randint(0, 60))) for _ in range(n)] + FIXED


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    from adjudica.llm.token_counts import token_counts

    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(9000, None, None, None), (None, "a b", "x", 1), (0, texts()[0], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, _t int")
    library = Tokenizer.from_file(WORD)
    found = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, WORD).collect())
    expected = sorted((i is None, i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, _, _ in rows)
    assert found == expected
    assert token_counts(docs.limit(0), WORD).count() == 0


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    from adjudica.llm.word_bpe import load

    library, own = Tokenizer.from_file(WORD), load(WORD)
    for t in texts():
        assert own.encode(t) == b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids)


def test_pieces_equal_the_library(spark):
    import sentencepiece

    from adjudica.llm.pieces import encode_decode

    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(9000, None, 1), (None, "a b", 1), (0, texts()[0], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)

    def digest(i, t):
        ids = library.encode(t or "") + [2]
        return i is None, i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    found = encode_decode(docs, PIECE)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    assert sorted((r.doc_id is None, *r[:4]) for r in found.collect()) == sorted(digest(i, t) for i, t, _ in rows)
    assert encode_decode(docs.limit(0), PIECE, keep=False).count() == 0


def test_decode_of_any_ids():
    import sentencepiece

    from adjudica.llm.pieces import load

    library, own, draw = sentencepiece.SentencePieceProcessor(model_file=PIECE), load(PIECE), random.Random(2)
    for _ in range(1500):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(3, 259), draw.randrange(3), 259]) for _ in range(draw.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids)


def test_whole_tables(spark):
    from tokenizers import Tokenizer

    from adjudica.llm.queries import op1_token_counts, op3_pieces

    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    library = Tokenizer.from_file(WORD)
    assert {r.doc_id: r.n_tokens for r in op1_token_counts(spark, d).collect()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in docs.items()}
    assert {r.doc_id: r.decoded_sha256 for r in op3_pieces(spark, d).collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in docs.items()}
