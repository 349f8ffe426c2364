"""Token counts of every prefix of a text, by dynamic programming over a BPE vocabulary.

A sequence of pieces is what BPE makes of their joined text exactly when BPE keeps every two
neighbours apart. So the last piece of a prefix is the one piece that ends there and gets on with the
last piece of what is left before it, and the prefix has one token more than that. Counts of all
prefixes come out of one pass and are stored as steps of one byte a character; truncation and budget
questions are then sums over steps, without the tokenizer.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollbook.llm.common import chunks, forget, map_arrow, rename_free

SPACE = "▁"
# Units and pairs a worker remembers; the older half goes when there are more.
MOST_UNITS, MOST_PAIRS = 600_000, 500_000
PREFIXES = "doc_id long, n_bytes long, n_tokens long, steps binary"


class PrefixCounter:
    """Prefix counts under a sentencepiece BPE model with byte fallback.

    Pieces of which BPE makes something else never end a prefix. A character that is no piece
    stands alone and counts its UTF-8 bytes.
    """

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        if sum(map(model.is_byte, ids)) != 256 or model.encode("  a") != model.encode("▁ a"):
            raise ValueError("needs a model with byte fallback that keeps white space")
        ordinary = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in ordinary}
        self.unit = self._units()
        # Each piece as BPE builds it, from the last merge down its left and down its right side:
        # the parts there, each with its own score and the score at which it is used up.
        self.names = [p for p in self.score if self.merged(p) == [p]]
        self.matches = ahocorasick.Automaton()
        for number, piece in enumerate(self.names):
            self.matches.add_word(piece, (number, len(piece)))
        self.matches.make_automaton()
        self.sides: dict[str, tuple[list, list]] = {}
        self.apart: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def _units(self) -> re.Pattern:
        """Cuts texts where no piece joins the two sides: before spaces, and around the largest
        group of characters that pieces join, which are the letters."""
        bare = [p.lstrip(SPACE) for p in self.score]
        if any(SPACE in p for p in bare):
            return re.compile("(?s).+")
        above: dict[str, str] = {}

        def root(c: str) -> str:
            while above.setdefault(c, c) != c:
                c = above[c]
            return c

        for piece in bare:
            for a, b in zip(piece, piece[1:], strict=False):
                above[root(a)] = root(b)
        groups = Counter(map(root, list(above)))
        if not groups:
            return re.compile(f"{SPACE}+|[^{SPACE}]")
        largest = max(groups, key=lambda c: (groups[c], c))
        own = "".join(map(re.escape, sorted(c for c in above if root(c) == largest)))
        return re.compile(f"{SPACE}*(?:[{own}]+|[^{own}{SPACE}]+|$)")

    def merged(self, text: str, least: int = 1) -> list[str]:
        """BPE of a short text: the neighbours with the best joined score merge first, from the left.
        It ends at ``least`` parts."""
        parts = list(text)
        while len(parts) > least:
            scores = [self.score.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            best = max((s for s in scores if s is not None), default=None)
            if best is None:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _side(self, piece: str) -> tuple[list, list]:
        """``(part, its score, score at which it is used up)`` down a piece's left and right side."""
        if piece not in self.sides:
            sides = []
            for left in (True, False):
                now, used, own = piece, -math.inf, []
                while len(now) > 1:
                    own.append((now, self.score[now], used))
                    parts = self.merged(now, 2)
                    now, used = parts[0 if left else 1], self.score[now]
                own.append((now, math.inf, used))
                sides.append(own)
            self.sides[piece] = sides[0], sides[1]
        return self.sides[piece]

    def _keeps_apart(self, left: str, right: str) -> bool:
        """Whether BPE of the joined text gives back the two pieces.

        Merges go by falling score, so parts ``x`` and ``y`` that meet at the boundary merge if their
        joined score comes before either is used up. Where scores are equal BPE itself decides.
        """
        score = self.score
        if left[-1] + right[0] not in score and len(left) == len(right) == 1:
            return True
        for x, x_score, x_used in self._side(left)[1]:
            for y, y_score, y_used in self._side(right)[0]:
                joined = score.get(x + y)
                if joined is None or x_score < y_used or y_score < x_used or joined < x_used or joined < y_used:
                    continue
                if x_score > y_used and y_score > x_used and joined > x_used and joined > y_used:
                    return False
                return self.merged(left + right) == [left, right]
        return True

    def steps(self, unit: str) -> bytes:
        """By how much each character of a unit changes the number of tokens, as signed bytes."""
        names, apart = self.names, self.apart
        # The last piece of every prefix, or -1, and its tokens. Of the pieces that end at a place one fits.
        last, count = [-1] * (len(unit) + 1), [0] * (len(unit) + 1)
        settled = 0
        for at, (piece, size) in self.matches.iter(unit):
            end = at + 1
            if end <= settled:
                continue
            while settled < at:
                settled = self._alone(unit, settled, count)
            before = last[end - size]
            if before >= 0:
                pair = before << 32 | piece
                kept = apart.get(pair)
                if kept is None:
                    kept = apart[pair] = self._keeps_apart(names[before], names[piece])
                if not kept:
                    continue
            last[end], count[end], settled = piece, count[end - size] + 1, end
        while settled < len(unit):
            settled = self._alone(unit, settled, count)
        return bytes([(b - a) & 255 for a, b in zip(count, count[1:], strict=False)])

    @staticmethod
    def _alone(unit: str, settled: int, count: list[int]) -> int:
        """The next character is no piece and counts its bytes."""
        count[settled + 1] = count[settled] + len(unit[settled].encode())
        return settled + 1

    def encode(self, text: str) -> bytes:
        """The steps of a whole text, after the one of the space that the model puts in front."""
        if not text:
            return b""
        known, fresh = self.known, self._fresh
        return b"".join([known.get(u) or fresh(u) for u in self.unit.findall(SPACE + text.replace(" ", SPACE)) if u])

    def _fresh(self, unit: str) -> bytes:
        forget(self.apart, MOST_PAIRS)
        own = self.steps(unit)
        if len(unit) < 100:
            forget(self.known, MOST_UNITS)
            self.known[unit] = own
        return own


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """One counter a worker process, whatever the number of its tasks."""
    return PrefixCounter(path)


def totals(steps: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, ... characters."""
    counts = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)
    if len(counts):
        counts[0] = 0
    return counts if len(counts) else np.zeros(1, np.int64)


def prefix_counts(documents: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", keep_steps: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, steps`` of every row, in no order.

    ``n_tokens`` is what the library gives for the whole text without begin and end. ``steps`` has a signed
    byte for the space put in front and for each code point; sums over it are the counts of prefixes
    (``totals``). Null and empty texts have no tokens and empty steps. Repeated rows and rows
    without doc_id come back as they are; an empty table gives no rows. ``keep_steps=False`` leaves the steps out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for part in chunks(batches, "text"):
            steps = [own.encode(t or "") for t in part["text"].to_pylist()]
            tokens = [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps]
            columns = [
                part["doc_id"].combine_chunks(),
                pc.fill_null(pc.binary_length(part["text"]), 0).cast(pa.int64()).combine_chunks(),
                pa.array(tokens, pa.int64()),
            ]
            if keep_steps:
                columns.append(pa.array(steps, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "steps"][: len(columns)])
        # The worker has other work to do before the next such task.
        own.known.clear()
        own.apart.clear()

    schema = PREFIXES if keep_steps else PREFIXES.rpartition(",")[0]
    rows = rename_free(documents, {"doc_id": doc_id, "text": text})
    return map_arrow(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def within(prefixes: DataFrame, budget: int) -> DataFrame:
    """``doc_id, n_chars, n_tokens`` of the longest prefix of at most ``budget`` tokens of every row.

    A longer prefix may have fewer tokens than a shorter one; the last that fits counts.
    """
    if budget < 0:
        raise ValueError("a budget is 0 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, tokens = [], []
            for steps in batch["steps"].to_pylist():
                counts = totals(steps or b"")
                ends.append(int(np.flatnonzero(counts <= budget)[-1]))
                tokens.append(int(counts[ends[-1]]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ends, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    return map_arrow(prefixes.select("doc_id", "steps"), run, "doc_id long, n_chars long, n_tokens long")


def truncate(documents: DataFrame, prefixes: DataFrame, budget: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text``: every text cut to its longest prefix of at most ``budget`` tokens.

    Rows meet by doc_id, so doc_ids of ``documents`` are to be unique; rows without one are left out.
    """
    ends = within(prefixes, budget).select("doc_id", "n_chars")
    rows = rename_free(documents, {"doc_id": doc_id, "text": text})
    return rows.join(ends, "doc_id").select("doc_id", F.expr("substring(text, 1, cast(n_chars as int))").alias("text"))


def counts_at(prefixes: DataFrame, positions: DataFrame) -> DataFrame:
    """``doc_id, position, n_tokens`` for each row of ``positions`` (``doc_id, position`` in characters).

    Positions beyond a text count all of it, null or negative ones nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for steps, at in zip(batch["steps"].to_pylist(), batch["position"].to_pylist(), strict=True):
                counts = totals(steps or b"")
                found.append(int(counts[min(max(at or 0, 0), len(counts) - 1)]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["position"], pa.array(found, pa.int64())], ["doc_id", "position", "n_tokens"])

    asked = positions.select("doc_id", F.col("position").cast("long").alias("position"))
    return map_arrow(prefixes.select("doc_id", "steps").join(asked, "doc_id"), run, "doc_id long, position long, n_tokens long")
