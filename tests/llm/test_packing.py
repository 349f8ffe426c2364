from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tollbook.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    model = Tokenizer.from_file(PATH)
    model.encode_special_tokens = True
    return lambda t: model.encode(t, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x24FF, exclude_categories=("Cs", "Cn")), max_size=40), max_size=4))
def test_ids_equal_the_library(texts):
    model = packing.word_tokenizer(PATH)
    data, ends = model.encode(pa.array([*texts, None], pa.string()))
    for text, start, end in zip([*texts, ""], [0, *ends.tolist()], ends.tolist(), strict=False):
        assert np.frombuffer(data[start:end], "<u4").tolist() == model.model.encode(text, add_special_tokens=False).ids


def test_space_of_all_kinds_and_long_words():
    texts = ["a\u3000b\xa0c", "x\x1cy\x1fz", " lead and trail \n", "\x85", "A\u2003B.", "w" * 250 + " " + "w" * 250, "e\u0301 \u0301", "", " "]
    model = packing.WordTokenizer(PATH)
    data, ends = model.encode(pa.array(texts))
    for text, start, end in zip(texts, [0, *ends.tolist()], ends.tolist(), strict=False):
        assert np.frombuffer(data[start:end], "<u4").tolist() == model.model.encode(text, add_special_tokens=False).ids


def test_latin_words_go_to_the_merges(library):
    letters = [chr(n) for n in range(0x100) if packing.LATIN.fullmatch(chr(n))]
    words = [*letters, "".join(letters), "\u00c9t\u00e9", "stra\u00dfe", "WORD", "w" * 300, "oe\u00ff", "I"]
    model = packing.WordTokenizer(PATH)
    whole, texts = model.model, []

    class Watched:
        def encode(self, text, **more):
            texts.append(text)
            return whole.encode(text, **more)

        def encode_batch(self, parts, **more):
            texts.extend(parts)
            return whole.encode_batch(parts, **more)

    model.model = Watched()
    got = model.learn(words)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [library(w) for w in words]
    assert not texts


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 4)
    model = packing.WordTokenizer(PATH)
    for n in range(5):
        text = f"word{n} some. of many, words {n}"
        data, ends = model.encode(pa.array([text]))
        assert np.frombuffer(data[: ends[0]], "<u4").tolist() == model.model.encode(text, add_special_tokens=False).ids
    assert len(model.known) < 25


def check(frame, capacity):
    rows = frame.sort_values(["sequence_id", "offset"])
    ends = rows.groupby("sequence_id")["length"].cumsum()
    assert (ends - rows["length"] == rows["offset"]).all()
    assert ends.max() <= capacity


def test_pieces_and_places(odd, library):
    got = packing.pack(packing.pieces(odd, PATH)).toPandas()
    check(got, 2048)
    texts = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    want = []
    for key, text in texts:
        ids = [*library(text), 0]
        for n, start in enumerate(range(0, len(ids), 2048)):
            own = ids[start : start + 2048]
            want.append((-1 if key is None else key, n, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    own = got[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-1).astype(int)
    assert sorted(own.itertuples(index=False, name=None)) == sorted(want)


def test_pools_reach_the_bound(spark):
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.geometric(0.02, 3_000), 100).tolist()
    cut = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECES)
    got = packing.pack(cut, capacity=100, partition_pieces=150).toPandas()
    assert len(got) == 3_000 and not got.duplicated(["doc_id", "piece"]).any()
    check(got, 100)
    whole = packing.best_fit_decreasing(np.array(lengths), 100)[2]
    assert packing.lower_bound(np.array(lengths), 100) <= got["sequence_id"].nunique() <= whole + 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_bounds_hold(lengths):
    """The lower bound is at most, and the packing at least, the fewest bins there are."""

    def fewest(rest, rooms):
        if not rest:
            return len(rooms)
        best = fewest(rest[1:], [*rooms, 12 - rest[0]])
        for n, room in enumerate(rooms):
            if room >= rest[0] and room not in rooms[:n]:
                best = min(best, fewest(rest[1:], [*rooms[:n], room - rest[0], *rooms[n + 1 :]]))
        return best

    exact = fewest(lengths, [])
    bins, offsets, used = packing.best_fit_decreasing(np.array(lengths), 12)
    assert packing.lower_bound(np.array(lengths), 12) <= exact <= used
    fill = np.bincount(bins, weights=lengths)
    assert fill.max() <= 12 and len(fill) == used
    assert all(offsets[n] + lengths[n] <= fill[bins[n]] for n in range(len(lengths)))


def test_empty(documents):
    assert packing.pack(packing.pieces(documents([]), PATH)).count() == 0
