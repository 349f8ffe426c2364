"""Exact Jaccard join of word-shingle sets with set-relation skipping.

Sets are ordered by rarity within a quarter of the hash space, so that only that quarter's
shingles travel: two sets can only link if they share one of their first few shingles in that
order, and the place of the first one bounds the size of the other set. Those lists, split where sizes
or places no longer fit, tie sets to candidate clusters. Sets of large clusters are ordered once more, by rarity among
themselves in the whole hash space, which leaves the ties of few. Each
cluster's texts meet in one place (or in blocks of bounded size by set size, each with those whose sizes
allow a link). There, index lists are
sorted by set size, so a set skips the blocks of each list with sets too small for it, and its
overlap counts are derived from those of the set before it by the shingles in which the two differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollbook.llm.common import chunks, components, map_arrow, marked, prefilter, rename_free, written

SHINGLE_WORDS, LEAST_PERCENT = 5, 80
# Parts of the hash space, taken in turn until they hold a set's prefix.
PARTS = 4
# Counts of a shingle's sets are exact up to here; a list is kept in memory only so far.
MOST_COUNTED = 1 << 20
# Sets of a cluster that meet in one task; larger clusters are cut into blocks of this size.
BLOCK_SETS = 2_000
# Sets of a list that are passed over for a set, at most, as their places do not allow a link with it.
PASSED = 16
CACHE_WORDS = 500_000


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    A-Z are lower-cased; words lie between ASCII white space. A text with fewer words than a
    shingle is one shingle; without words the set is empty.
    """

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        value = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        look, miss = self.known.get, self._hash
        for text in texts:
            words = (text or "").encode().lower().split()
            if not words:
                out.append(np.empty(0, np.uint64))
            elif len(words) < self.words:
                out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64))
            else:
                one = np.fromiter((look(w) or miss(w) for w in words), np.uint64, len(words))
                n = len(words) - self.words + 1
                mixed = one[:n].copy()
                for k in range(1, self.words):
                    mixed *= np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(29)
                    mixed += one[k : k + n]
                mixed *= np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(32)
                out.append(np.unique(mixed))
        return out


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set; equal sets have equal names."""
    value = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return value - (1 << 64) if value >= 1 << 63 else value


def prefix_length(n: int, percent: int) -> int:
    """Of two sets that link, the first so many shingles have one in common, in any order."""
    return n - -(-percent * n // 100) + 1


def sent(shingles: np.ndarray, percent: int, parts: int) -> tuple[np.ndarray, list[int]]:
    """The shingles of the first ``parts`` of the hash space that hold the prefix, and where each part ends."""
    ends = np.searchsorted(shingles, np.array([(n << 64) // parts for n in range(1, parts)], np.uint64)).tolist() + [len(shingles)]
    need = prefix_length(len(shingles), percent)
    held = next((n for n, end in enumerate(ends, 1) if end >= need), parts)
    return shingles[: ends[held - 1]], ends[:held]


def _profile(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for part in chunks(batches, "text"):
            sets = shingler.sets(part["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"].combine_chunks(),
                    part["content"].combine_chunks(),
                    pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([sent(s, percent, PARTS)[1] if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "content", "sid", "n", "ends"],
            )

    return run


def _postings(words: int, percent: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for part in chunks(batches, "text"):
            own = {set_id(s): sent(s, percent, parts)[0] for s in shingler.sets(part["text"].to_pylist()) if len(s)}
            if own:
                tokens = np.concatenate(list(own.values())).view(np.int64)
                ids = np.repeat(np.fromiter(own, np.int64, len(own)), [len(s) for s in own.values()])
                for start in range(0, len(tokens), 100_000):
                    yield pa.RecordBatch.from_pydict(
                        {"token": tokens[start : start + 100_000], "sid": ids[start : start + 100_000]}
                    )

    return run


def _runs(columns: tuple[str, ...], batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of whole runs of the first one, several runs at once; a run of ``most`` rows or
    more may come in pieces, the first of at least that length, the last of any."""
    held: list[np.ndarray] = []
    for batch in batches:
        new = [batch[c].to_numpy() for c in columns]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
        if not len(held[0]):
            continue
        last = np.flatnonzero(held[0] != held[0][-1])
        cut = int(last[-1]) + 1 if len(last) else 0
        if len(held[0]) - cut >= most:
            cut = len(held[0])
        if cut:
            yield tuple(x[:cut] for x in held)
            held = [x[cut:] for x in held]
    if held and len(held[0]):
        yield tuple(held)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings without copies, which are next to each other."""
    last = None
    for batch in batches:
        token, sid = batch["token"].to_numpy(), batch["sid"].to_numpy()
        if len(token):
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
            new[0] = (token[0], sid[0]) != last
            last = token[-1], sid[-1]
            yield pa.RecordBatch.from_pydict({"token": token[new], "sid": sid[new]})


def _shared(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings of shingles that two sets or more have, with their number of sets, ``most`` at
        most. Rows come sorted by shingle and set. All rows of a shingle have one number, since
        sets have to order their shingles alike: the later pieces of a cut run have ``most``."""
        last = None
        for token, sid in _runs(("token", "sid"), _distinct(batches), most):
            start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            count = np.repeat(np.diff(np.r_[start, len(token)]), np.diff(np.r_[start, len(token)]))
            if last is not None:
                count[token == last] = most
            last = token[-1]
            keep = count > 1
            yield pa.RecordBatch.from_pydict({"sid": sid[keep], "token": token[keep], "sets": np.minimum(count[keep], most)})

    return run


def largest_partner(n: Column, place: Column, percent: int) -> Column:
    """The size of the largest set that a set of ``n`` shingles can link with, if the first shingle that both have
    stands at ``place`` of its order: those before it are in no other."""
    return F.floor((100 * (n - place) - percent * place) / percent)


def _chains(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ties within lists sorted by size, ``most`` being the largest partner that a set's place in its order allows.

        A set that allows partners of its own size or more is open. Each set is tied to the nearest open one before it that
        is neither too small nor, by its own place, too large; all others before it that may link with it are open too,
        and are tied to that one in the same way.
        """
        # Open sets of the last list, one of each size: those of a size are tied.
        open_ = tuple(np.zeros(0, np.int64) for _ in range(4))
        for batch in batches:
            new = [batch[c].to_numpy() for c in ("token", "n", "sid", "most")]
            if not len(new[0]):
                continue
            held = len(open_[0])
            token, n, sid, most = (np.r_[x, y] for x, y in zip(open_, new, strict=True))
            group = np.cumsum(np.r_[0, token[1:] != token[:-1]])
            opens = np.flatnonzero(most >= n)
            wide = int(max(n.max(), most.max())) + 1
            # How many open ones stand before each set and are not too large for it.
            at = np.minimum(
                np.searchsorted(opens, np.arange(len(token))),
                np.searchsorted(group[opens] * wide + n[opens], group * wide + np.maximum(most, 0), "right"),
            )
            at[:held] = 0
            left, steps = np.flatnonzero(at), 0
            ties = []
            while len(left):
                other = opens[at[left] - 1]
                near = (group[other] == group[left]) & (100 * n[other] >= percent * n[left])
                left, other = left[near], other[near]
                fits = most[other] >= n[left] if steps < PASSED else np.ones(len(left), bool)
                ties.append((sid[other[fits]], sid[left[fits]]))
                left, steps = left[~fits], steps + 1
                at[left] -= 1
                left = left[at[left] > 0]
            pairs = np.concatenate([np.stack(t) for t in ties], axis=1) if ties else np.empty((2, 0), np.int64)
            pairs = np.unique(pairs, axis=1) if pairs.size else pairs
            yield pa.RecordBatch.from_pydict({"a": pairs[0], "b": pairs[1]})
            keep = opens[(group[opens] == group[-1]) & (100 * n[opens] >= percent * n[-1])]
            keep = keep[np.lexsort((most[keep], n[keep]))]
            keep = keep[np.r_[n[keep][1:] != n[keep][:-1], True]] if len(keep) else keep
            open_ = tuple(x[keep] for x in (token, n, sid, most))

    return run


def links_among(sets: list[np.ndarray], sides: np.ndarray | None, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set in turn, the earlier ones it links with. ``sets`` come in order of size.

    ``sides``: the block of each set where only pairs of two blocks count, or None.
    """
    size = np.array([len(s) for s in sets])
    tokens, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(code, kind="stable")
    lists, begin = owner[order], np.searchsorted(code[order], np.arange(len(tokens) + 1))
    codes = np.split(code, np.cumsum(size)[:-1])
    count, before, member = np.zeros(len(sets), np.int64), None, np.zeros(len(tokens), bool)

    def add(some: np.ndarray, least: int, sign: int) -> None:
        # The lists are sorted by set size: the part before the first set that is large enough is skipped.
        parts = [lists[begin[t] : begin[t + 1]] for t in some.tolist()]
        parts = [p[np.searchsorted(p, least) :] if p[0] < least else p for p in parts]
        if parts:
            found = np.concatenate(parts)
            np.add(count, sign * np.bincount(found, minlength=len(count)), out=count)

    for n, own in enumerate(codes):
        least = int(np.searchsorted(size, -(-percent * size[n] // 100)))
        fresh = own
        if before is not None:
            fresh = own[~member[own]]
            member[before] = False
            member[own] = True
            gone = before[~member[before]]
            if len(gone) + len(fresh) < len(own):
                add(gone, least, -1)
            else:
                count[:] = 0
                fresh = own
        else:
            member[own] = True
        add(fresh, least, 1)
        before = own
        common = count[least:n]
        hit = 100 * common >= percent * (size[n] + size[least:n] - common)
        if sides is not None:
            hit &= sides[least:n] != sides[n]
        yield n, least + np.flatnonzero(hit)


def _cluster_links(words: int, percent: int):
    def solve(shingler: Shingler, rows: list[tuple], across: bool) -> tuple[list, list, list]:
        members, taken = [], set()
        for row, own in zip(rows, shingler.sets([r[3] for r in rows]), strict=True):
            if set_id(own) == row[0] and row[0] not in taken:
                taken.add(row[0])
                members.append((len(own), int(own[0]), row, own))
        members.sort(key=lambda m: m[:2])
        a, b, links = [], [], []
        if len(members) < 2:
            return a, b, links
        sids = [m[2][0] for m in members]
        copies = np.array([m[2][1] for m in members])
        sides = np.array([m[2][2] for m in members]) if across else None
        label, degree = np.arange(len(members)), np.zeros(len(members), np.int64)
        for n, partners in links_among([m[3] for m in members], sides, percent):
            if len(partners):
                degree[n] += copies[partners].sum()
                degree[partners] += copies[n]
                roots, first = np.unique(label[partners], return_index=True)
                for root, at in zip(roots, first, strict=True):
                    a.append(sids[n]), b.append(sids[partners[at]]), links.append(0)
                label[np.isin(label, roots)] = label[n]
        for sid, d in zip(sids, degree.tolist(), strict=True):
            if d:
                a.append(sid), b.append(sid), links.append(d)
        return a, b, links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, now = Shingler(words), None
        rows: dict[tuple, tuple] = {}  # by set and text: a text counts once

        def result() -> pa.RecordBatch:
            columns = zip(("a", "b", "links"), solve(shingler, list(rows.values()), now[1] != now[2]), strict=True)
            return pa.RecordBatch.from_pydict({name: pa.array(v, pa.int64()) for name, v in columns})

        for part in chunks(batches, "text"):
            keys = zip(part["cluster"].to_pylist(), part["low"].to_pylist(), part["high"].to_pylist(), strict=True)
            columns = [part[c].to_pylist() for c in ("sid", "copies", "side", "text")]
            for key, row in zip(keys, zip(*columns, strict=True), strict=True):
                if key != now and rows:
                    yield result()
                    rows = {}
                now = key
                rows.setdefault((row[0], row[3]), row)
        if rows:
            yield result()

    return run


def join(
    documents: DataFrame,
    words: int = SHINGLE_WORDS,
    percent: int = LEAST_PERCENT,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, n_links``.

    Two documents link when their sets' intersection is at least ``percent`` hundredths of their
    union. ``component_id`` is the smallest doc_id that links reach, the document itself included;
    ``n_links`` counts the other documents it links with. Null and empty texts have no shingles,
    link with nothing and are their own component. Repeated rows link with each other. Rows
    without doc_id take part but name no component. Sets are told apart by 64-bit hashes.
    """
    return _joined(documents, words, percent, doc_id, text).select("doc_id", "n_shingles", "component_id", "n_links")


def _joined(documents: DataFrame, words: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """The rows of ``join`` with the hash of their text and the name of their component."""
    rows = rename_free(documents, {"doc_id": doc_id, "text": text}).withColumn("content", F.xxhash64("text"))
    profile = written(
        map_arrow(rows, _profile(words, percent), "doc_id long, content long, sid long, n long, ends array<long>"),
        "sets",
    )
    sets = (
        profile.where("sid is not null").groupBy("sid")
        .agg(
            F.min("content").alias("content"), F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"),
            *(F.first(c).alias(c) for c in ("n", "ends")),
        )
    )
    sets = written(sets, "distinct-sets")

    clusters = components(_ties(rows.select("text"), sets, words, percent, PARTS), "candidates").withColumnRenamed("component", "cluster")
    large = clusters.groupBy("cluster").count().where(F.col("count") > BLOCK_SETS).select("cluster")
    if not large.isEmpty():
        crowded = written(clusters.join(large, "cluster").withColumnRenamed("node", "sid").join(sets.select("sid", "content"), "sid"), "crowded")
        texts = prefilter(rows.select("content", "text"), "content", crowded, "content").select("text")
        again = components(_ties(texts, sets, words, percent, 1), "candidates").withColumnRenamed("component", "cluster")
        again = again.join(crowded.select(F.col("sid").alias("node")), "node", "left_semi")
        clusters = clusters.join(large, "cluster", "left_anti").select("node", "cluster").unionByName(again)
    members = written(_units(clusters, sets, percent), "cluster-members")
    # Copies of a text are folded in every task; `copies` has their number. Texts are dealt by content once.
    texts = (
        prefilter(rows.select("content", "text"), "content", members, "content")
        .groupBy("content").agg(F.collect_set("text").alias("texts"))
        .join(members, "content").withColumn("text", F.explode("texts"))
    )
    found = written(
        map_arrow(
            texts.select("cluster", "low", "high", "side", "sid", "copies", "text")
            .repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high"),
            _cluster_links(words, percent),
            "a long, b long, links long",
        ),
        "links",
    )
    groups = components(found.where("links = 0").select("a", "b"), "components")
    degrees = found.where("links > 0").groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    classes = (
        sets.select("sid", "copies", "first_doc")
        .join(groups.withColumnRenamed("node", "sid"), "sid", "left").join(degrees, "sid", "left")
        .select(
            "sid", "first_doc", F.coalesce("component", "sid").alias("class"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    named = classes.join(classes.groupBy("class").agg(F.min("first_doc").alias("component_id")), "class")
    return (
        profile.join(named.select("sid", "class", "component_id", "n_links"), "sid", "left")
        .select(
            "doc_id", "content", "class", F.col("n").alias("n_shingles"),
            F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        )
    )


def _ties(texts: DataFrame, sets: DataFrame, words: int, percent: int, parts: int) -> DataFrame:
    """Ties ``(a, b)`` that connect all sets of the texts that can link. Shingles are ordered by part of the hash space,
    of which there are ``parts``, then by the number of these texts' sets that have them."""
    postings = map_arrow(texts, _postings(words, percent, parts), "token long, sid long")
    shared = map_arrow(
        postings.repartition("token").sortWithinPartitions("token", "sid"), _shared(MOST_COUNTED), "sid long, token long, sets long"
    )
    # Unshared shingles come first in their part, so the place of a shared one follows from where its
    # part ends and how many shared ones stand up to there.
    part = F.shiftrightunsigned("token", 65 - parts.bit_length()).cast("int") if parts > 1 else F.lit(0)
    ends = F.col("ends") if parts > 1 else F.array("n")
    so_far = F.array(*(F.sum(F.when(part <= p, 1).otherwise(0)) for p in range(parts)))
    place = F.element_at("ends", F.col("o.part") + 1) - F.element_at("so_far", F.col("o.part") + 1) + F.col("rank")
    kept = (
        shared.groupBy("sid").agg(F.collect_list(F.struct(part.alias("part"), "sets", "token")).alias("own"), so_far.alias("so_far"))
        .join(sets.select("sid", "n", ends.alias("ends")), "sid")
        .select("sid", "n", "ends", "so_far", F.posexplode(F.array_sort("own")).alias("rank", "o"))
        .select(F.col("o.token").alias("token"), "n", "sid", place.alias("place"))
        .where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100))
        .select("token", "n", "sid", largest_partner(F.col("n"), F.col("place"), percent).alias("most"))
    )
    return map_arrow(kept.repartition("token").sortWithinPartitions("token", "n", "sid"), _chains(percent), "a long, b long")


def _units(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The sets of each cluster in units ``(cluster, low, high)`` of one block or two, all in which they may link.

    Blocks have some ``BLOCK_SETS`` sets of sizes next to each other. Two blocks meet if their sizes allow a link,
    and only with those sets whose sizes do.
    """
    sized = clusters.withColumnRenamed("node", "sid").join(sets.select("sid", "content", "copies", "n"), "sid")
    before = Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    cells = sized.groupBy("cluster", "n").agg(F.count("*").alias("here")).withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0)))
    turn = F.col("before") + F.pmod(F.xxhash64("sid"), F.col("here"))
    sided = written(
        sized.join(cells, ["cluster", "n"]).select("cluster", F.floor(turn / BLOCK_SETS).alias("side"), "n", "sid", "copies", "content"),
        "cluster-sides",
    )
    blocks = sided.groupBy("cluster", "side").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    low = blocks.select("cluster", F.col("side").alias("low"), F.col("most").alias("low_most"))
    high = blocks.select("cluster", F.col("side").alias("high"), F.col("least").alias("high_least"))
    pairs = low.join(high, "cluster").where((F.col("low") <= F.col("high")) & (100 * F.col("low_most") >= percent * F.col("high_least")))
    units = pairs.withColumn("side", F.explode(F.array_distinct(F.array("low", "high"))))
    fits = (F.col("low") == F.col("high")) | F.when(F.col("side") == F.col("low"), 100 * F.col("n") >= percent * F.col("high_least")).otherwise(
        percent * F.col("n") <= 100 * F.col("low_most")
    )
    return sided.join(units, ["cluster", "side"]).where(fits).select("cluster", "low", "high", "side", "sid", "copies", "content")


def keep_one(
    documents: DataFrame, words: int = SHINGLE_WORDS, percent: int = LEAST_PERCENT,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The rows, with all their columns, of the smallest doc_id of each component, once each.

    Rows without doc_id stay, and so does every document without words.
    """
    joined = _joined(documents, words, percent, doc_id, text).where("doc_id is not null")
    texts = joined.groupBy("doc_id", "content").agg(
        F.count("*").alias("rows"), F.first("class").alias("class"), F.first("component_id").alias("component_id")
    )
    # One doc_id may stand on rows of several components, and on several texts of one.
    own = Window.partitionBy("doc_id", "class").orderBy("content")
    stays = (F.col("doc_id") == F.col("component_id")) & (F.row_number().over(own) == 1)
    judged = texts.select("doc_id", "content", "rows", stays.alias("stays")).where(~F.col("stays") | (F.col("rows") > 1))
    judged = written(judged.select("doc_id", "content", "stays"), "judged")
    # Most rows stay as they are and need not travel; the others meet their verdict.
    rows = documents.select(F.struct("*").alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("content"))
    rows = marked(rows, "doc_id", judged, "doc_id", "may_go")
    at_once = rows.where("doc_id is null or not may_go")
    same = Window.partitionBy("doc_id", "content").orderBy("content")
    met = (
        rows.where("doc_id is not null and may_go").join(judged, ["doc_id", "content"], "left").where("coalesce(stays, true)")
        .withColumn("copy", F.row_number().over(same)).where("stays is null or copy = 1")
    )
    return at_once.select("row.*").unionByName(met.select("row.*"))
