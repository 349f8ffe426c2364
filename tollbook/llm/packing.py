"""Best-fit packing of token pieces into sequences, certified by dual-feasible functions.

Pieces are dealt to partitions of bounded size. Each packs its own by best-fit decreasing and
bounds its bins from below with dual-feasible functions. Bins that a partition cannot justify,
and its emptiest one, give their pieces back; eight partitions pool what they gave back and
pack it again, and so on until one pool is left.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollbook.llm.common import chunks, forget, map_arrow, rename_free, session_of, written

CAPACITY = 2048
PARTITION_PIECES = 20_000
POOL = 8
# A partition gives back at most so many pieces, so that a pool of eight stays bounded.
MOST_RETURNED = PARTITION_PIECES // POOL
CACHE_WORDS = 150_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, pool long, bin long, offset long, open boolean, bins long, bound long"
# Punctuation that ends a word and is always a token run of its own.
TAIL = ".,;:!?*#$%&|"
CLOSING = rf"(\pL)([{TAIL}]+)([\t\n\v\f\r ]|$)"
# Words of these letters are one token run and in normal form.
LATIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


class WordTokenizer:
    """Ids of whole texts. White space always separates tokens of this vocabulary, so words are
    encoded once and remembered. Other white space than ASCII's stays in a word, which the library then cuts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.merge = self.model.model.tokenize
        # The vocabulary spells the UTF-8 bytes of lower case.
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters = [c for c in map(chr, range(0x100)) if LATIN.fullmatch(c)]
        self.spelled = str.maketrans({c: spell(c.lower())[0][0] for c in letters})
        self.known: dict[str, bytes] = {}

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of each part. Latin words go to the merges at once, without the library's look at
        normal forms and runs. Other parts of letters or of closing marks only are one token run each, so
        they go through the tokenizer as one text."""
        found: dict[str, bytes] = {}
        for part in filter(LATIN.fullmatch, parts):
            found[part] = array("I", [token.id for token in self.merge(part.translate(self.spelled))]).tobytes()
        plain = [p for p in parts if p not in found and (p.isalpha() or not p.strip(TAIL))]
        for start in range(0, len(plain), 5_000):
            some = plain[start : start + 5_000]
            one = self.model.encode(" ".join(some), add_special_tokens=False)
            runs = np.array(one.word_ids)
            cut = np.flatnonzero(np.diff(runs)) + 1
            if len(cut) + 1 == len(some):
                ids = np.array(one.ids, "<u4").tobytes()
                ends = [0, *(4 * cut).tolist(), len(ids)]
                found.update((p, ids[a:b]) for p, a, b in zip(some, ends, ends[1:], strict=False))
        rest = [p for p in parts if p not in found]
        alone = self.model.encode_batch(rest, add_special_tokens=False)
        found.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(rest, alone, strict=True))
        return [found[p] for p in parts]

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of each word; those met for the first time are encoded together."""
        forget(self.known, CACHE_WORDS)
        fresh = list(set(words).difference(self.known))
        new = dict(zip(fresh, self._ids(fresh), strict=True))
        self.known.update(new)
        out = list(map(self.known.__getitem__, words))
        for word in [w for w in fresh if len(w) >= 100]:
            del self.known[word]
        return out

    def encode(self, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
        """The ids of all texts behind each other, and where each text's ids end in bytes.

        Arrow cuts the texts at ASCII white space and before closing marks, numbers the different words
        and sets their ids in place of them; only different words are looked at one by one.
        """
        texts = texts.cast(pa.large_string())
        # The vocabulary has lower case only. Beside other letters than ASCII's, case is left to the library.
        texts = pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts)
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, CLOSING, r"\1 \2\3"))
        words = cut.flatten().dictionary_encode()
        ids = pa.array(self.learn(words.dictionary.to_pylist()), pa.large_binary()).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset) if len(ids) else np.zeros(1, np.int64)
        data = memoryview(ids.buffers()[2]) if len(ids) and ids.buffers()[2] is not None else memoryview(b"")
        return data, ends[np.cumsum(pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False), dtype=np.int64)]


@lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process."""
    return WordTokenizer(path)


def pieces(
    documents: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    with_ids: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Token pieces of every whole text, ended by ``end_id``; only longer ones are cut.

    A null or empty text is the end id alone. Repeated rows give their pieces again. ``with_ids``
    adds the ids themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_tokenizer(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for part in chunks(batches, "text"):
            ids, ends = model.encode(part["text"].combine_chunks())
            starts = [0, *ends.tolist()]
            rows: list[list] = [[], [], [], [], [], []]
            for n, key in enumerate(part["doc_id"].to_pylist()):
                tokens = bytes(ids[starts[n] : starts[n + 1]]) + end
                for piece, start in enumerate(range(0, len(tokens) // 4, capacity)):
                    own = tokens[4 * start : 4 * (start + capacity)]
                    for column, value in zip(rows, (key, piece, start, len(own) // 4, zlib.crc32(own), own), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(rows, kinds, strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4") for x in rows[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        # The worker has other work to do before the next such task.
        model.known.clear()

    schema = PIECES + ", ids array<int>" * with_ids
    return map_arrow(rename_free(documents, {"doc_id": doc_id, "text": text}), run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every piece, and the number of bins. A piece goes to the fullest bin that
    can take it; the bins by free space are stacks, found by the lowest bit set in a mask."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = used = 0
    for n in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[n])
        fits = mask >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, own, used = capacity, used, used + 1
        bins[n], offsets[n] = own, capacity - room
        by_room[room - length].append(own)
        if room > length:
            mask |= 1 << (room - length)
    return bins, offsets, used


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound of two families of dual-feasible functions over the counts by length.

    For each threshold, pieces above capacity less threshold count as whole bins and those below
    the threshold as nothing; for each k, lengths are rounded to parts of k.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1)
    mass, number = np.cumsum(counts * sizes), np.cumsum(counts)
    e = np.arange(0, capacity // 2 + 1)
    big = number[-1] - number[capacity - e]
    middle = mass[capacity - e] - np.where(e > 0, mass[np.maximum(e - 1, 0)], 0)
    best = int((big + -(-middle // capacity)).max())
    for k in range(1, 60):
        parts = sizes * (k + 1)
        whole = parts % capacity == 0
        # In units of 1 / (k * capacity), to stay with whole numbers.
        value = np.where(whole, sizes * k, (parts // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def _pack(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=used)
        held = np.bincount(bins, minlength=used)
        emptiest = np.argsort(fill, kind="stable")
        # The bins beyond the bound, with as many to fill up, and one more.
        give = emptiest[: 1 + 4 * (used - bound)]
        give = give[(fill[give] < capacity) & (np.cumsum(held[give]) <= MOST_RETURNED)]
        open_bin = np.zeros(used, bool)
        open_bin[give] = True
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "pool"]].assign(
            bin=bins, offset=offsets, open=open_bin[bins], bins=used, bound=bound
        )

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """Place every piece of ``cut`` (``doc_id, piece, start, length, ids_crc32``; lengths from 1 to
    ``capacity``): adds ``sequence_id`` and ``offset``. Every piece is placed once; offsets in a
    sequence have no gaps. No pieces give no rows.
    """
    session_of(cut)
    cut = written(cut, "packing-pieces")
    pools = max(1, -(-cut.count() // partition_pieces))
    rest = cut.withColumn("pool", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(pools)))
    placed, level = [], 0
    while True:
        packed = written(rest.groupBy("pool").applyInPandas(_pack(capacity), PACKED), f"packing-{level}")
        done = packed if pools == 1 else packed.where("not open")
        number = (F.lit(level).cast("long") * (1 << 56)) + F.col("pool") * (1 << 20) + F.col("bin")
        placed.append(done.withColumn("sequence_id", number))
        if pools == 1:
            break
        pools = -(-pools // POOL)
        rest = packed.where("open").withColumn("pool", (F.col("pool") / POOL).cast("long"))
        level += 1
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
