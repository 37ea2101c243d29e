from __future__ import annotations

import base64
import hashlib
import random
import sys
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bidweave.llm import byte_bpe, token_counts
from bidweave.llm.bpe_core import SHIFT, _merge_long, _merge_short

ALPHABET = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "é", "1", "٣", "!", "#", "日", "😀", "　", "\r", "'ll", "''", "▁", "\0", "Thee", "ing", "<s>"]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(token_counts.default_model())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join) | st.text(max_size=40))
def test_byte_bpe_equals_the_library(tik, text):
    bpe = byte_bpe.encoder(byte_bpe.default_ranks())
    raw, starts = next(bpe.encode([text]))
    assert np.frombuffer(raw, "<u4").tolist() == tik.encode_ordinary(text)
    assert bpe.decode(raw) == text.encode()
    assert list(starts) == sorted(set(starts)) and (not text or starts[0] == 0)


def test_batches_do_not_leak_into_each_other(tik):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))) for _ in range(500)]
    bpe = byte_bpe.encoder(byte_bpe.default_ranks())
    assert [np.frombuffer(r, "<u4").tolist() for r, _ in bpe.encode(texts)] == [tik.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join) | st.text(max_size=40))
def test_counts_equal_the_library(pieces, counter, text):
    assert counter.count(text) == len(pieces.encode(text))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=20).map("".join), st.integers(0, 12))
def test_longest_prefix_within_budget(pieces, counter, text, budget):
    assert counter.fits(text, budget) == max(i for i in range(len(text) + 1) if len(pieces.encode(text[:i])) <= budget)


def test_stores_may_be_emptied(pieces):
    small = token_counts.PrefixCounter(token_counts.default_model())
    small.KEPT = 20
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(ALPHABET) for _ in range(20))
        assert small.count(text) == len(pieces.encode(text))


def test_long_and_short_merging_agree():
    rng = random.Random(1)
    pairs = {a << SHIFT | b: 10 + a * 7 + b for a in range(60) for b in range(60) if (a * 31 + b) % 3 == 0}
    for _ in range(200):
        symbols = [rng.randrange(6) for _ in range(rng.randint(0, 40))]
        assert _merge_long(symbols, pairs.get) == _merge_short(symbols, pairs.get)


def test_op9_edges(documents, edges, tik):
    rows = byte_bpe.encode_documents(documents(edges), keep_ids=True, keep_offsets=True).collect()
    assert len(rows) == len(edges)
    texts = {d: t or "" for d, t in edges}
    for r in rows:
        ids = tik.encode_ordinary(texts[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert byte_bpe.encode_documents(documents([])).count() == 0


def test_decode_ids(documents, edges):
    encoded = byte_bpe.encode_documents(documents(edges), keep_ids=True)
    texts = {d: t or "" for d, t in edges}
    for r in byte_bpe.decode_ids(encoded).collect():
        assert r["decoded"] == texts[r["doc_id"]]


def test_op3_edges(documents, edges, pieces):
    rows = token_counts.token_counts(documents(edges), budget=8).collect()
    assert len(rows) == len(edges)
    texts = {d: t or "" for d, t in edges}
    for r in rows:
        text = texts[r["doc_id"]]
        n = len(pieces.encode(text))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 8)
        assert len(pieces.encode(text[: r["fit_chars"]])) <= 8
    assert token_counts.token_counts(documents([])).count() == 0


@pytest.mark.parametrize(("lead", "kind"), [("X", byte_bpe.LETTER), ("1", byte_bpe.NUMBER), ("#", byte_bpe.OTHER)])
def test_classes_are_those_of_the_library_for_every_code_point(lead, kind):
    """In a vocabulary that joins ``lead`` with any byte, it joins those that its run of the pattern takes along."""
    points = [i for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    ranks = {bytes([i]): i for i in range(256)} | {lead.encode() + bytes([i]): 256 + i for i in range(256)}
    joins = tiktoken.Encoding("joins", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = np.concatenate([joins.encode_ordinary("".join(lead + chr(i) + " " for i in points[a : a + 50_000])) for a in range(0, len(points), 50_000)])
    starts = dict(zip((np.cumsum(1 + (ids >= 256)) - 1 - (ids >= 256)).tolist(), ids.tolist()))
    lengths = np.array([2 + len(chr(i).encode()) for i in points])
    taken = [starts[a] >= 256 for a in (np.cumsum(lengths) - lengths).tolist()]
    assert taken == (byte_bpe.classes()[points] == kind).tolist()


@pytest.mark.parametrize("text", ["\U000105c0're", "x\u1c8a's", "\U0001e5f1\U0001e5f2a", "a\U00010d4a1"])
def test_letters_of_newer_unicode(tik, text):
    assert np.frombuffer(next(byte_bpe.encoder(byte_bpe.default_ranks()).encode([text]))[0], "<u4").tolist() == tik.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=20).map("".join))
def test_counts_at_every_prefix(pieces, counter, text):
    assert counter.all_prefixes(text) == [len(pieces.encode(text[:i])) for i in range(len(text) + 1)]


def test_prefix_counts_answer_budgets(documents, edges, pieces):
    texts = {d: t or "" for d, t in edges if len(t or "") < 1000}
    rows = token_counts.token_counts(documents(edges), keep_prefixes=True)
    for r in rows.select("doc_id", "n_tokens", token_counts.tokens_at(F.col("prefix_tokens"), 7).alias("at7"), token_counts.longest_within(F.col("prefix_tokens"), 5).alias("fit5"), "prefix_tokens").collect():
        assert r["prefix_tokens"][-1] == r["n_tokens"]
        if r["doc_id"] in texts:
            text = texts[r["doc_id"]]
            assert r["at7"] == len(pieces.encode(text[:7]))
            assert r["fit5"] == max(i for i in range(len(text) + 1) if len(pieces.encode(text[:i])) <= 5)


@pytest.mark.parametrize("text", ["a" * 400_000, "-" * 400_000, " " * 400_000, "x" + " " * 400_000 + "y" * 400_000])
def test_long_texts_take_linear_time(counter, text):
    before = time.time()
    assert counter.all_prefixes(text)[counter.fits(text, 4096)] <= 4096
    next(byte_bpe.encoder(byte_bpe.default_ranks()).encode([text]))
    assert time.time() - before < 30
