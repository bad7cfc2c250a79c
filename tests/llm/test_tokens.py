import random

import pytest

from quire.llm import tokens

BITS = [" ", "  ", "\n", "\t", "▁", "a", "bc", "The", "é", "ß", "ab\r", "\r\n", " \n", "世", "界", "🙂", "\x00", "　", "1", "23", ".", "</s>", "ﬁ", "é", "​", "def f(x):", "    return", "<0x0A>", "<unk>"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.tokenizer_path())
    return lambda t: len(model.encode(t or ""))


def test_equals_the_library(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)  # the cache starts anew again and again
    own = tokens.Encoder(tokens.tokenizer_path())
    assert own.parts
    r = random.Random(5)
    texts = ["".join(r.choice(BITS) for _ in range(r.randint(0, 16))) for _ in range(4000)] + ["x" * 5000, "a b " * 3000, "\n" * 50, " " * 40]
    assert [own.count(t) for t in texts] == [library(t) for t in texts]


def test_whole_texts_if_pieces_do_not_allow_the_split(library):
    own = tokens.Encoder(tokens.tokenizer_path())
    own.parts = False
    assert own.count("a  b\nc") == library("a  b\nc")


def test_query(spark, library):
    rows = [(1, "Hello world, hello\nworld"), (2, None), (3, ""), (4, "word " * 5000), (None, "ü b"), (4, "dup"), (4, "dup")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "true as over_limit")
    got = sorted(map(tuple, tokens.token_counts(frame, tokens.tokenizer_path()).collect()), key=str)
    assert got == sorted([(i, len((t or "").encode()), library(t), library(t) > 4096) for i, t in rows], key=str)
    assert tokens.token_counts(frame.limit(0), tokens.tokenizer_path()).count() == 0
