from __future__ import annotations

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from tollbook.llm import prefix_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)


def of_prefixes(text: str) -> list[int]:
    return [len(ids) for ids in LIBRARY.encode([text[:n] for n in range(len(text) + 1)])]


PARTS = st.sampled_from([" ", "  ", "▁", "a", "b", "er", "the", "ing", "T", "\n", "\t", ".", "...", "é", "ß", "東", "😀", "1", "=", "==", "//", "\x00", "　", "²", "_", "<s>", "<0x41>"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(PARTS, max_size=14).map("".join), st.text(max_size=25)))
def test_every_prefix_equals_the_library(text):
    assert prefix_counts.totals(prefix_counts.counter(PATH).encode(text)).tolist() == of_prefixes(text)


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 70), st.integers(0, 5))
def test_runs_of_spaces(n, before):
    text = "a" * before + " " * n + "x"
    assert prefix_counts.totals(prefix_counts.counter(PATH).encode(text)).tolist() == of_prefixes(text)


def test_pairs_kept_apart_are_those_that_merging_keeps():
    own = prefix_counts.counter(PATH)
    some = random.Random(3).sample(own.names, 150) + ['▁' * n for n in (1, 2, 3, 8, 16)]
    for left in some:
        for right in some:
            assert own._keeps_apart(left, right) == (own.merged(left + right) == [left, right])


def test_memory_is_bounded_and_results_stay(monkeypatch):
    monkeypatch.setattr(prefix_counts, "MOST_UNITS", 5)
    monkeypatch.setattr(prefix_counts, "MOST_PAIRS", 5)
    own = prefix_counts.PrefixCounter(PATH)
    text = "many different words are forgotten and counted again, many words"
    assert prefix_counts.totals(own.encode(text)).tolist() == of_prefixes(text)
    assert len(own.known) <= 6 and len(own.apart) < 500


def test_rows(odd, spark):
    got = prefix_counts.prefix_counts(odd, PATH).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    expected = sorted((str(i), len(t.encode()), len(LIBRARY.encode(t))) for i, t in texts)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == expected
    sizes = {str(i): len(t) + 1 if t else 0 for i, t in texts}
    assert all(len(r["steps"]) == sizes[str(r["doc_id"])] for r in got)
    assert prefix_counts.prefix_counts(odd, PATH, keep_steps=False).columns == ["doc_id", "n_bytes", "n_tokens"]
    assert prefix_counts.prefix_counts(odd.limit(0), PATH).count() == 0


@pytest.mark.parametrize("budget", [0, 1, 5, 12])
def test_budgets(spark, documents, budget):
    pairs = [(1, "the thing is in the other thing's place"), (2, ""), (3, None), (4, "東京 2024"), (5, "short"), (None, "x")]
    frame = documents(pairs)
    stored = prefix_counts.prefix_counts(frame, PATH)
    got = {r["doc_id"]: (r["n_chars"], r["n_tokens"]) for r in prefix_counts.within(stored, budget).collect()}
    cut = {r["doc_id"]: r["text"] for r in prefix_counts.truncate(frame, stored, budget).collect()}
    for doc_id, text in pairs:
        counts = of_prefixes(text or "")
        end = max(n for n, c in enumerate(counts) if c <= budget)
        assert got[doc_id] == (end, counts[end])
        if doc_id is not None:
            assert cut[doc_id] == (text[:end] if text is not None else None)
    assert None not in cut


def test_counts_at_positions(spark, documents):
    text = "the thing is in the other thing's place"
    stored = prefix_counts.prefix_counts(documents([(1, text), (2, None)]), PATH)
    asked = spark.createDataFrame([(1, n) for n in range(len(text) + 3)] + [(1, None), (1, -4), (2, 7), (9, 1)], "doc_id long, position long")
    got = {(r["doc_id"], r["position"]): r["n_tokens"] for r in prefix_counts.counts_at(stored, asked).collect()}
    counts = of_prefixes(text)
    assert got == {(1, n): counts[min(n, len(text))] for n in range(len(text) + 3)} | {(1, None): 0, (1, -4): 0, (2, 7): 0}


def test_very_long_unit():
    text = "ab" * 30_000
    assert prefix_counts.totals(prefix_counts.counter(PATH).encode(text))[-1] == len(LIBRARY.encode(text))
