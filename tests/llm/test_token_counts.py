"""Token counts against the library itself."""

import random

import public_tokenizers
import pytest

from taskmill.llm.token_counts import HEAD_BYTES, PreTokens, count_tokens, load_pre_tokens

ODD = [
    None, "", "", " ", "   ", "\n", "\n\n a", "a\x00b", "▁ ▁▁x", "日本語 text\t\tmore", "é é \U0001F600\U0001F600",
    " lead and trail  ", "<s> </s> <unk> <0x0A> ▁<s>", "x" * 30_000, "no break", "\r\nab\r", "the " * 9000,
    "word line﻿", "العربية हिन्दी", "a" * 300 + " " + "ab" * 2000,
]
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pre_tokens():
    return load_pre_tokens(MODEL)


def expected(pre_tokens, texts):
    library = pre_tokens.library()
    counts = [len(library.encode(t or "")) for t in texts]
    return [(len((t or "").encode()), n, n > 4096) for t, n in zip(texts, counts)]


@pytest.mark.parametrize("head_bytes", [HEAD_BYTES, 2000, 1])
def test_equals_the_library(spark, pre_tokens, head_bytes):
    rng = random.Random(8)
    texts = ODD + ["".join(rng.choice("abcde  é\n\t.,1日ﬁ▁") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    rows = [(i // 2, t, 5, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, __unit string").repartition(3)
    got = count_tokens(df, pre_tokens, head_bytes=head_bytes)
    assert got.columns == ["doc_id", "text", "__unit", "n_bytes", "n_tokens", "over_limit"]
    want = [(i // 2, t, "clash", *e) for (i, t), e in zip(enumerate(texts), expected(pre_tokens, texts))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_limit_and_nothing(spark, pre_tokens):
    df = spark.createDataFrame([(1, "one two three"), (None, "one")], "doc_id long, text string")
    got = {r.doc_id: r.over_limit for r in count_tokens(df, pre_tokens, limit=2, keep=("doc_id",)).collect()}
    assert got == {1: True, None: False}
    assert count_tokens(df.limit(0), pre_tokens).collect() == []


def test_large_texts_fall_apart_alike(pre_tokens, monkeypatch):
    from taskmill.llm import token_counts

    text = "some words\nand  others " * 500
    at_once = pre_tokens.splitter()(text)
    monkeypatch.setattr(token_counts, "SLICE_BYTES", 100)
    assert pre_tokens.splitter()(text) == at_once
    assert pre_tokens.counter()(["▁some", "words", "\n", "▁▁"]) == [1, 1, 1, 1]


def test_a_model_that_does_not_fall_apart_takes_whole_texts(spark, pre_tokens):
    whole = PreTokens(pre_tokens.model)
    whole.whole = True
    texts = ["a b", "a b", "c\n d", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r)[1:] for r in count_tokens(df, whole, keep=("doc_id",)).collect())
    assert got == sorted(expected(pre_tokens, texts))
