"""Token ids against two public libraries that read the same vocabulary."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyrill.llm.bpe import VOCABULARY, Encoder, encode_texts, encoder

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    own = encoder()
    from tallyrill.llm.bpe import PATTERN

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab 'st\n\t1é字😀​<|>", max_size=80))
def test_any_text(reference, text):
    assert encoder().encode([text]) == [reference.encode_ordinary(text)]


def test_long_words_and_memory_bounds(reference, monkeypatch):
    import tallyrill.llm.bpe as module

    monkeypatch.setattr(module, "WORDS", 5)
    monkeypatch.setattr(module, "PAIRS", 5)
    own, rng = Encoder(), random.Random(1)
    for _ in range(6):
        texts = ["".join(rng.choice("abcdeé ") for _ in range(60)) for _ in range(4)] + ["ab" * 3000, "<|endoftext|>", "a" * 2000]
        assert own.encode(texts) == [reference.encode_ordinary(t) for t in texts]


def test_round_trip():
    own = encoder()
    text = "Résumé — 東京 \r\n\t x" * 3
    assert b"".join(own.token[i] for i in own.encode([text])[0]).decode() == text


def test_rows(spark, reference):
    data = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "x"), (4, "word " * 50_000)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "'clash' as ids")
    got = sorted(((r["doc_id"], list(r["ids"])) for r in encode_texts(df, "doc_id", "text").collect()), key=repr)
    assert got == sorted(((i, reference.encode_ordinary(t or "")) for i, t in data), key=repr)
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0
