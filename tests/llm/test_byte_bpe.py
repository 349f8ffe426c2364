"""Equal to the rank file's own encoder, and an exact round trip."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tollbook.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    ranks = byte_bpe.vocabulary(PATH).ranks
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(encoded: bytes) -> list[int]:
    return byte_bpe.np.frombuffer(encoded, "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn")), max_size=60), max_size=5))
def test_equals_the_library(texts):
    ranks = byte_bpe.vocabulary(PATH).ranks
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = byte_bpe.Encoder(PATH, PATTERN)
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert ids(got) == library.encode_ordinary(text)
        assert encoder.decode(got) == text.encode()


@pytest.mark.parametrize("piece", ["a" * 255, "a" * 257, "ab" * 2_000, " " * 700, "é" * 400, "qzx" * 90])
def test_long_pieces(reference, piece):
    assert ids(byte_bpe.Encoder(PATH, PATTERN).encode([piece])[0]) == reference.encode_ordinary(piece)


def test_other_pattern_is_cut_by_itself():
    library = tiktoken.Encoding("own", pat_str=r"\w+|\W+", mergeable_ranks=byte_bpe.vocabulary(PATH).ranks, special_tokens={})
    text = "two words, and  more\nlines"
    assert ids(byte_bpe.Encoder(PATH, r"\w+|\W+").encode([text])[0]) == library.encode_ordinary(text)


def test_rows(odd, reference):
    got = byte_bpe.encode_digest(odd, PATH, PATTERN).collect()
    assert len(got) == odd.count()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for row in got:
        text = texts[row["doc_id"]]
        expected = byte_bpe.np.array(reference.encode_ordinary(text), "<u4").tobytes()
        assert row["n_tokens"] == len(expected) // 4
        assert row["ids_sha256"] == hashlib.sha256(expected).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_ids_and_bytes(odd):
    encoded = byte_bpe.encode(odd, PATH, PATTERN)
    back = byte_bpe.decode(encoded, PATH).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert all(bytes(r["bytes"]) == texts[r["doc_id"]].encode() for r in back)


def test_empty_table(documents):
    assert byte_bpe.encode_digest(documents([]), PATH, PATTERN).count() == 0
