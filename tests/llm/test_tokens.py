import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filigree.llm import tokens

HARD = ["", " ", "\n\n", "a", "it's  we'll\t\tgo", "=" * 3000, "𝒳𝒴 🇯🇵 é", "<|endoftext|> x", "日本語の文 12345 ½", "﻿​\r\n x\r\n\r\n ", "naïve — “q”", "\x00\x01"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5), max_size=60))
def test_lexicon_numbers_words(some):
    entries = {w: [i, i + 1][: 1 + i % 2] for i, w in enumerate(sorted(some))}
    lexicon = tokens.Lexicon(tokens.compile_lexicon(entries))
    got = lexicon.numbers(sorted(some))
    assert got.tolist() == list(range(len(some)))
    for w, n in zip(sorted(some), got):
        assert lexicon.ids[lexicon.offsets[n] : lexicon.offsets[n + 1]].tolist() == entries[w]
    others = [w + b"x" for w in some if w + b"x" not in some] + [w[:-1] for w in some if w[:-1] not in some]
    assert all(n < 0 for n in lexicon.numbers(others))


def test_lexicon_is_minimal():
    words = [a + b for a in (b"walk", b"talk", b"park", b"mark") for b in (b"ing", b"ed", b"er", b"s")]
    states = tokens.compile_lexicon({w: [1] for w in words})[3]
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    futures = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
    assert states == len(futures)


def test_encoder_equals_library(plain):
    entries = {w: list(i) for w, i in ((b" the", [262]), (b"a", [64]))}
    encoder = tokens.Encoder(tokens.Lexicon(tokens.compile_lexicon(entries)))
    offsets, ids = encoder.encode([*HARD, None])
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [*(plain(x) for x in HARD), []]


def test_corpus(spark, plain):
    rng = random.Random(3)
    texts = [*HARD, None, *(" ".join(rng.choices(["the", "graph", "näher", "Kante", "グラフ", "x1"], k=30)) for _ in range(40))]
    rows = [(i // 2, t, "n", "i") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, out string")
    expected = sorted((i, plain(t) if t else []) for i, t, _, _ in rows)
    for size in (0, 3, 1000):
        got = tokens.encode_corpus(df, "doc_id", "text", size=size).collect()
        assert sorted((r.doc_id, r.ids) for r in got) == expected
    counts = tokens.encode_corpus(df, "doc_id", "text", counts_only=True).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in counts) == sorted((i, len(x)) for i, x in expected)
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_lexicon_counts_all_texts(spark):
    """A word that two of many texts hold is met twice, and the most frequent words are those of all texts."""
    n = 12_000
    df = spark.range(2 * n).selectExpr(f"cast(id % {n} as string) as text").unionAll(spark.range(3).selectExpr("' again' as text"))
    for size, expected in ((tokens.LEXICON_WORDS, [" again", *map(str, range(n))]), (1, [" again"])):
        lexicon = tokens.Lexicon(tokens.build_lexicon(df, "text", size=size))
        assert len(lexicon.offsets) - 1 == len(expected)
        assert (lexicon.numbers([w.encode() for w in expected]) >= 0).all()


def test_memo_starts_afresh(monkeypatch, plain):
    monkeypatch.setattr(tokens, "_MEMO_WORDS", 3)
    encoder = tokens.Encoder(None)
    for text in ("one two three four", "five one six", "two"):
        offsets, ids = encoder.encode([text])
        assert ids.tolist() == plain(text) and offsets.tolist() == [0, len(ids)]
    assert isinstance(ids, np.ndarray)
