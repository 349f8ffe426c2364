"""Byte-level BPE in padded numpy matrices, equal to what a merge table's own encoder gives.

Texts are cut by the split pattern. Pieces a task has not met yet are sorted into buckets of
similar length; a bucket is one matrix of token ids, a row per piece. In each round every row
merges its leftmost pair of lowest rank: pair ranks come from an open-addressed hash table and are
kept beside the ids, so a round looks up only the two pairs next to each merge. Rows without a
pair left leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tollbook.llm.common import chunks, forget, map_arrow, rename_free

NONE = np.int32(2**31 - 1)
# The split pattern for which texts may be cut at single spaces first; a fixed value.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space other than single spaces and line breaks between words.
RUNS = re.compile(r"\s\s|[^\S \n]|\A\s|\s\Z|\x00")
# Pieces up to these byte lengths share a matrix; a longer piece is merged with a heap, because
# rounds over a row cost the square of its length.
BUCKETS = (4, 8, 12, 16, 24, 32, 48, 64, 128, 256)
MATRIX_CELLS = 1 << 19
CACHE_PIECES = 500_000
OUTPUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PairTable:
    """Rank of a pair of token ids, by hashing; ``NONE`` where the pair is no token."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 2.5).bit_length()))
        self.size = 1 << int(64 - self.shift)
        self.keys = np.full(self.size, -1, np.int64)
        self.ranks = np.full(self.size, NONE, np.int32)
        rest, values, slots = keys, ranks, self._slot(keys)
        while len(rest):
            free = np.flatnonzero(self.keys[slots] == -1)
            _, first = np.unique(slots[free], return_index=True)
            placed = free[first]
            self.keys[slots[placed]], self.ranks[slots[placed]] = rest[placed], values[placed]
            left = np.ones(len(rest), bool)
            left[placed] = False
            rest, values, slots = rest[left], values[left], (slots[left] + 1) & (self.size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slots = self._slot(keys)
        out = np.full(keys.shape, NONE, np.int32)
        wanted = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        flat_keys, flat_out, slots = keys.ravel()[wanted], out.ravel(), slots.ravel()[wanted]
        while len(wanted):
            held = self.keys[slots]
            hit = held == flat_keys
            flat_out[wanted[hit]] = self.ranks[slots[hit]]
            on = ~hit & (held != -1)
            wanted, flat_keys, slots = wanted[on], flat_keys[on], (slots[on] + 1) & (self.size - 1)
        return flat_out.reshape(keys.shape)


class Vocabulary:
    """A rank file: one base64 token and its rank to a line."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, lines))}
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {
            (ranks[token[:cut]] << 32) | ranks[token[cut:]]: rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        }
        self.pairs = PairTable(
            np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        )

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece. A piece that is a token itself is that token."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for n, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[n] = np.array([rank], np.int32)
            elif piece:
                width = next((w for w in BUCKETS if len(piece) <= w), 0)
                by_width.setdefault(width, []).append(n)
        for n in by_width.pop(0, []):
            out[n] = self.merge_long(pieces[n])
        for width, rows in by_width.items():
            step = max(1, MATRIX_CELLS // width)
            for start in range(0, len(rows), step):
                part = rows[start : start + step]
                for n, ids in zip(part, self.merge_matrix([pieces[n] for n in part], width), strict=True):
                    out[n] = ids
        return out

    def merge_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)
        ids = self.single[raw].reshape(len(pieces), width)
        ids[np.arange(width) >= lengths[:, None]] = -1
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        row, done = np.arange(len(pieces)), [None] * len(pieces)
        while len(row):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(row), np.int64)
            best = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), NONE)
            over = best == NONE
            if over.any():
                for n, tokens in zip(row[over], ids[over], strict=True):
                    done[n] = tokens[tokens >= 0]
                on = ~over
                row, ids, rank, at, best = row[on], ids[on], rank[on], at[on], best[on]
                if not len(row):
                    break
            # One column fewer: the merged pair's right token and its rank go.
            n, every = len(row), np.arange(len(row))
            ids[every, at] = best
            keep = np.ones(ids.shape, bool)
            keep[every, at + 1] = False
            ids = ids[keep].reshape(n, -1)
            keep = np.ones(rank.shape, bool)
            keep[every, at] = False
            rank = rank[keep].reshape(n, -1)
            if rank.shape[1]:
                left, right = at > 0, at < rank.shape[1]
                before, after = every[left], every[right]
                rank[before, at[left] - 1] = self.pairs.find(ids[before, at[left] - 1], ids[before, at[left]])
                rank[after, at[right]] = self.pairs.find(ids[after, at[right]], ids[after, at[right] + 1])
        return done

    def merge_long(self, piece: bytes) -> np.ndarray:
        """One long piece: the same merges from a heap of ``(rank, position)`` over linked tokens."""
        ranks, tokens = self.ranks, [piece[n : n + 1] for n in range(len(piece))]
        after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        end = len(tokens)
        heap = [(r, n) for n in range(end - 1) if (r := ranks.get(tokens[n] + tokens[n + 1])) is not None]
        heapify(heap)
        while heap:
            rank, n = heappop(heap)
            right = after[n] if tokens[n] else end
            if right == end or ranks.get(tokens[n] + tokens[right]) != rank:
                continue
            tokens[n] += tokens[right]
            tokens[right] = b""
            after[n] = after[right]
            if after[n] < end:
                before[after[n]] = n
            for a, b in ((before[n], n), (n, after[n])):
                if a >= 0 and b < end and (r := ranks.get(tokens[a] + tokens[b])) is not None:
                    heappush(heap, (r, a))
        return np.array([ranks[t] for t in tokens if t], np.int32)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Whole texts to ids and back; remembers a bounded number of words and pieces.

    The words between single spaces are looked up whole: with this split pattern (a space joins
    what follows it, other white space stands alone) no piece crosses such a space or a single
    line break. Texts with longer runs of white space, and texts under another pattern, are cut
    by the pattern as a whole.
    """

    def __init__(self, path: str, pattern: str):
        self.words = vocabulary(path)
        self.split = regex.compile(pattern)
        self.by_word = pattern == WORD_PATTERN
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def units(self, text: str) -> list[str]:
        if not self.by_word or RUNS.search(text):
            return self.split.findall(text)
        # A mark in front of every space, and on both sides of every line break.
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.units(text) for text in texts]
        forget(self.known, CACHE_PIECES)
        forget(self.pieces, CACHE_PIECES)
        fresh = list({unit for units in cut for unit in units if unit not in self.known})
        split = list(map(self.split.findall, fresh))
        new = list({piece for pieces in split for piece in pieces if piece not in self.pieces})
        found = self.words.encode_pieces([piece.encode() for piece in new])
        self.pieces.update((p, ids.astype("<u4").tobytes()) for p, ids in zip(new, found, strict=True))
        look = self.pieces.__getitem__
        self.known.update((u, b"".join(map(look, pieces))) for u, pieces in zip(fresh, split, strict=True))
        look = self.known.__getitem__
        return [b"".join(map(look, units)) for units in cut]

    def clear(self) -> None:
        """At the end of a task: the worker has other work to do before the next one of this kind."""
        self.known.clear()
        self.pieces.clear()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def encoder_of(path: str, pattern: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path, pattern)


def encode(
    documents: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode every whole text: ``doc_id, ids`` with the ids as an array of ints.

    A null or empty text has no ids. Repeated rows and null doc_ids stay, one output row each;
    other columns are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, pattern)
        for part in chunks(batches, "text"):
            ids = [np.frombuffer(x, "<u4") for x in encoder.encode([t or "" for t in part["text"].to_pylist()])]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"].combine_chunks(), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
            )
        encoder.clear()

    return map_arrow(rename_free(documents, {"doc_id": doc_id, "text": text}), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Bytes of each row's ids: ``doc_id, bytes``. Null ids give no bytes; an unknown id fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path).tokens
        for batch in batches:
            out = [b"".join(map(tokens.__getitem__, row or ())) for row in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return map_arrow(rename_free(encoded, {"doc_id": doc_id, "ids": ids}), run, "doc_id long, bytes binary")


def encode_digest(
    documents: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode every whole text and decode its ids again, as counts and digests.

    Same rows as ``encode``; the ids stay inside the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, pattern)
        for part in chunks(batches, "text"):
            ids = encoder.encode([t or "" for t in part["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"].combine_chunks(),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        encoder.clear()

    return map_arrow(rename_free(documents, {"doc_id": doc_id, "text": text}), run, OUTPUT)
