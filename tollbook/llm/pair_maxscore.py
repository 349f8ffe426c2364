"""Ranked search by MaxScore with bounds on pairs of terms.

Documents are indexed in shards of bounded size, a row each, with all lists of the shard. Beside the
lists of terms a shard holds those of term pairs: the documents that have both, and the maximum of
their joint impacts. MaxScore leaves long lists of small impact closed as long as documents that have
nothing else stay below the threshold, and looks them up only for documents found in the open lists.
Pairs leave more of them closed, in two ways. Closed terms are bounded by disjoint pairs, each by
max(a, b, joint) in place of a + b. And a term beyond them needs only the list of a pair of it with a closed
term opened, if documents that have the one without the other stay below the threshold.

Joint impacts also give each query a threshold before any shard is searched: in each shard the documents
that stand highest in a list of one of its terms or pairs are scored, and the k-th best of all these is a
score that k documents reach.

Impacts are integers, so scores are exact in any order of adding.
"""

from __future__ import annotations

import math
import pickle
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollbook.llm.common import chunks, map_arrow, rename_free, session_of, written

# A shard ends at so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 4_096, 1_000_000
# Terms to index that are sent to the tasks; with more of them every term is indexed.
MOST_TERMS = 500_000
# Queries of one search, by their terms; more are searched in blocks.
BLOCK_TERMS = 200_000
# A term's pairs are with so many terms of next smaller weight.
PARTNERS = 4
SCALE, SATURATION, LENGTH_PERCENT = 1_000_000_000, 1_000, 90
# A-Z become lower case, digits, letters and all bytes of other characters stay, the rest separates.
TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
INDEX = (
    "shard long, ids array<long>, lengths array<long>, terms array<string>, ends array<int>, places array<int>, counts array<int>"
)
PAIRED = (
    f"{INDEX}, left array<string>, right array<string>, most array<long>, pair_ends array<int>, pair_places array<int>, "
    "items array<long>, floors array<array<long>>"
)
FOUND = "item_id long, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a whole text, with repeats."""
    return (text or "").encode().translate(TABLE).split()


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.array([v.tolist() if v.dtype == object else v for v in values], pa.list_(kind))


def _index(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = terms.value if terms is not None else None
        shard = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        ids: list[int | None] = []
        lengths: list[int] = []
        numbers: dict[bytes, int] = {}
        held, docs, counts = array("i"), array("i"), array("i")

        def row() -> pa.RecordBatch:
            number, place = np.array(held, np.int32), np.array(docs, np.int32)
            order = np.argsort(number, kind="stable")
            ends = np.searchsorted(number[order], np.arange(1, len(numbers) + 1)).astype(np.int32)
            columns = [
                pa.array([shard], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                pa.array([[t.decode() for t in numbers]], pa.list_(pa.string())), _lists([ends], pa.int32()),
                _lists([place[order]], pa.int32()), _lists([np.array(counts, np.int32)[order]], pa.int32()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["shard", "ids", "lengths", "terms", "ends", "places", "counts"])

        for part in chunks(batches, "text"):
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                found = terms_of(text)
                if not found:
                    continue
                own = Counter(found)
                for term in own if wanted is None else own.keys() & wanted:
                    held.append(numbers.setdefault(term, len(numbers)))
                    docs.append(len(ids))
                    counts.append(own[term])
                ids.append(doc_id)
                lengths.append(len(found))
                if len(ids) >= SHARD_DOCS or len(held) >= SHARD_POSTINGS:
                    yield row()
                    shard += 1
                    ids, lengths, numbers, held, docs, counts = [], [], {}, array("i"), array("i"), array("i")
        if ids:
            yield row()

    return run


def query_terms(queries: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, term``: the distinct terms of each query; rows of one item are one query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            found = [sorted({t.decode() for t in terms_of(text)}) for text in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["item_id"].combine_chunks(), pa.array(found, pa.list_(pa.string()))], ["item_id", "terms"])

    rows = rename_free(queries, {"item_id": item_id, "text": text}).where("item_id is not null")
    rows = rows.select(F.col("item_id").cast("long").alias("item_id"), "text")
    split = map_arrow(rows, run, "item_id long, terms array<string>")
    return written(split.select("item_id", F.explode("terms").alias("term")).distinct(), "ranked-queries")


def build(documents: DataFrame, asked: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all documents with a term, written to the shared folder.

    ``asked`` (``item_id, term``) limits the lists to terms that some query has; lengths and the number of
    documents always cover all terms. With more different terms than ``MOST_TERMS``, or without ``asked``, every term is indexed.
    """
    spark = session_of(documents)
    wanted = None
    if asked is not None:
        terms = asked.select("term").distinct().limit(MOST_TERMS + 1).collect()
        if len(terms) <= MOST_TERMS:
            wanted = spark.sparkContext.broadcast(frozenset(r["term"].encode() for r in terms))
    rows = rename_free(documents, {"doc_id": doc_id, "text": text})
    return written(map_arrow(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _index(wanted), INDEX), "ranked-index")


def weigh(index: DataFrame, asked: DataFrame) -> tuple[DataFrame, int, int]:
    """``item_id, term, weight`` of the terms some document has, the number of documents, and of all their terms."""
    totals = index.agg(
        F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")
    ).first()
    documents, words = totals["n"] or 0, totals["l"] or 0
    sizes = F.transform(F.col("ends"), lambda e, n: e - F.when(n > 0, F.element_at("ends", n)).otherwise(0))
    df = index.select(F.explode(F.arrays_zip("terms", sizes.alias("sizes"))).alias("t")).groupBy("t.terms").agg(F.sum("t.sizes").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * documents + 2).cast("double") / (2 * F.col("df") + 1)))
    return written(asked.join(df.select(F.col("terms").alias("term"), "df"), "term").select("item_id", "term", weight.alias("weight")), "ranked-weights"), documents, words


def impacts(weight: np.ndarray | int, counts: np.ndarray, lengths: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What a term adds to the scores of documents, in whole numbers."""
    norm = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * lengths * documents) // words
    counts = counts.astype(np.int64)
    return weight * ((SCALE * counts) // (SATURATION * counts + 8 * norm))


class Shard:
    """A shard's lists as impacts."""

    def __init__(self, row: dict, weights: dict[str, int], documents: int, words: int):
        self.ids, lengths, self.places, counts = row["ids"], row["lengths"], row["places"], row["counts"]
        starts = np.r_[0, row["ends"]][:-1]
        self.span = {t: (s, e) for t, s, e in zip(row["terms"], starts.tolist(), row["ends"].tolist(), strict=True) if t in weights}
        weight = np.repeat(np.array([weights.get(t, 0) for t in row["terms"]], np.int64), row["ends"] - starts)
        self.impact = impacts(weight, counts, lengths[self.places], documents, words)

    def list(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        start, end = self.span.get(term, (0, 0))
        return self.places[start:end], self.impact[start:end]


def both(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The documents of two lists in both, with their joint impact."""
    if len(one[0]) > len(other[0]):
        one, other = other, one
    if not len(one[0]):
        return one
    at = np.minimum(np.searchsorted(other[0], one[0]), len(other[0]) - 1)
    hit = other[0][at] == one[0]
    return one[0][hit], one[1][hit] + other[1][at[hit]]


def partners(weights: dict[str, int]) -> list[tuple[str, str]]:
    """Pairs of a query's terms that are close in weight, so that either bound counts."""
    order = sorted(weights, key=lambda t: (-weights[t], t))
    return [(min(a, b), max(a, b)) for n, a in enumerate(order) for b in order[n + 1 : n + 1 + PARTNERS]]


def _array(row: pa.RecordBatch, column: str, n: int) -> np.ndarray:
    values = row[column][n].values
    return values.to_numpy(zero_copy_only=False) if values is not None else np.zeros(0, np.int64)


def _shard_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for n in range(batch.num_rows):
        row = {c: _array(batch, c, n) for c in ("lengths", "ends", "places", "counts")}
        yield row | {"shard": batch["shard"][n].as_py(), "ids": batch["ids"][n].values, "terms": batch["terms"][n].as_py()}


def _floor(shard: Shard, terms: dict[str, int], tops: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[int]:
    """Scores of the ``k`` documents to which a list of ``tops`` gives most."""
    if not tops:
        return []
    places, impact = (np.concatenate(x) for x in zip(*tops, strict=True))
    order = np.lexsort((-impact, places))
    first = order[np.r_[True, np.diff(places[order]) != 0]]
    found = np.sort(places[first[np.argsort(-impact[first], kind="stable")[:k]]])
    score = np.zeros(len(shard.ids), np.int64)
    for term in terms:
        _add(score, found, *shard.list(term))
    return np.sort(score[found])[::-1].tolist()


def _top(own: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    places, impact = own
    if len(impact) <= k:
        return own
    at = np.argpartition(impact, len(impact) - k)[-k:]
    return places[at], impact[at]


def _pairs(block, documents: int, words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards with the documents and joint maxima of the pairs that queries may use, and for each query
        the scores of the ``k`` documents that stand highest in one of its lists."""
        queries, weights = pickle.loads(block.value)
        pairs = sorted({p for own in queries.values() for p in partners(own)})
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        names = ["left", "right", "most", "pair_ends", "pair_places", "items", "floors"]
        none = np.zeros(0, np.int32)
        for batch in (b.slice(n, 1) for b in batches for n in range(b.num_rows)):
            [row] = _shard_rows(batch)
            shard = Shard(row, weights, documents, words)
            tops = {(t, t): _top(shard.list(t), k) for t in shard.span}
            most = {p: int(own[1].max()) for p, own in tops.items()}
            joint = {}
            for left, right in pairs:
                one, other = shard.list(left), shard.list(right)
                own = both(one, other)
                if len(own[0]):
                    tops[left, right], most[left, right] = _top(own, k), int(own[1].max())
                    # A list about as long as its term's own saves nothing.
                    if 2 * len(own[0]) <= min(len(one[0]), len(other[0])):
                        joint[left, right] = own[0]
            floors = [
                _floor(shard, own, [tops[p] for p in [*partners(own), *((t, t) for t in own)] if p in tops], k) for own in queries.values()
            ]
            lists = [joint.get(p, none) for p in most]
            added = (
                [p[0] for p in most], [p[1] for p in most], list(most.values()), np.cumsum([len(x) for x in lists], dtype=np.int32),
                np.concatenate([none, *lists]), list(queries), floors,
            )
            columns = [pa.array([c], pa.list_(t)) for c, t in zip(added, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return run


def plan(
    pairs: list[tuple[str, str]], sizes: dict[str, int], bound: dict[str, int], most: dict[tuple[str, str], int], least: int, listed=()
) -> tuple[list[str], list[int], dict[str, tuple[str, str]]]:
    """Which of a query's terms stay closed in a shard.

    Gives the closed terms, longest lists of least impact first, the bounds of their first 0, 1, ... terms
    together, and the terms that are opened only in the list of a pair. Documents outside the open lists
    score less than ``least``. ``pairs`` are those that the index knows, ``most`` has the joint maxima; one of
    them without a maximum has no document. ``listed`` are the pairs whose list is there.
    """
    order = sorted(sizes, key=lambda t: (bound[t] / sizes[t], t))
    known = {frozenset(p): p for p in pairs}
    both_most = lambda a, b: max(bound[a], bound[b], most.get(known[frozenset((a, b))], 0))
    closed, below, mate = [], [0], {}
    for term in order:
        adds, other = min([(bound[term], ""), *((both_most(term, c) - bound[c], c) for c in closed if c not in mate and frozenset((term, c)) in known)])
        if below[-1] + adds >= least:
            break
        if other:
            mate |= {term: other, other: term}
        closed.append(term)
        below.append(below[-1] + adds)
    opens = lambda a, b: (p := known.get(frozenset((a, b)))) is not None and (p in listed or p not in most)
    # What a bound loses with a closed term.
    share = {c: both_most(c, mate[c]) - bound[mate[c]] if c in mate else bound[c] for c in closed}
    top, used, paired = below[-1], set(), {}
    for term in order[len(closed) :]:
        choice = [
            (top - share[c] + bound[term], c)
            for c in closed
            if c not in used and mate.get(c) not in used and opens(term, c) and top - share[c] + bound[term] < least
        ]
        if choice:
            without, other = min(choice)
            top = max(top, without)
            used.add(other)
            paired[term] = known[frozenset((term, other))]
    return closed, below, paired


def max_score(shard: Shard, terms: dict[str, int], most: dict, lists: dict, least: int, k: int, seen: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the shard's documents that can be among the ``k`` best and score ``least`` or more.

    ``lists`` has the documents of pairs. ``seen`` counts postings opened, looked up and there.
    """
    own = {t: shard.list(t) for t in terms if t in shard.span}
    sizes, bound = {t: len(own[t][0]) for t in own}, {t: most[t, t] for t in own}
    seen[2] += sum(sizes.values())
    closed, below, paired = plan(partners(terms), sizes, bound, most, max(least, 1), lists)
    score, found = np.zeros(len(shard.ids), np.int64), np.zeros(len(shard.ids), bool)
    for term in own.keys() - closed - paired.keys():
        places, impact = own[term]
        score[places] += impact
        found[places] = True
        seen[0] += len(places)
    for pair in paired.values():
        if pair in lists:
            found[lists[pair]] = True
            seen[0] += len(lists[pair])
    alive = np.flatnonzero(found)
    rest = below[-1] + sum(bound[t] for t in paired)
    left = [(rest - sum(bound[x] for x in list(paired)[: n + 1]), t) for n, t in enumerate(paired)]
    left += [(below[n], closed[n]) for n in range(len(closed) - 1, -1, -1)]
    for after, term in left:
        if len(alive) > k:
            # The k-th best sum so far is a score that k documents reach.
            least = max(least, int(np.partition(score[alive], len(alive) - k)[len(alive) - k]))
        alive = alive[score[alive] + rest >= least]
        if not len(alive):
            break
        seen[1] += _add(score, alive, *own[term])
        rest = after
    alive = alive[score[alive] >= max(least, 1)]
    if len(alive) > k:
        alive = alive[score[alive] >= np.partition(score[alive], len(alive) - k)[len(alive) - k]]
    return alive, score[alive]


def _add(score: np.ndarray, alive: np.ndarray, places: np.ndarray, impact: np.ndarray) -> int:
    """Add a list's impacts to documents that are looked up in it; how many were."""
    if not len(places) or not len(alive):
        return 0
    at = np.minimum(np.searchsorted(places, alive), len(places) - 1)
    hit = places[at] == alive
    score[alive[hit]] += impact[at[hit]]
    return len(alive)


def _search(block, least: dict[int, int], documents: int, words: int, k: int, opened):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = pickle.loads(block.value)
        for batch in batches:
            for n, row in enumerate(_shard_rows(batch)):
                shard = Shard(row, weights, documents, words)
                names = list(zip(batch["left"][n].as_py(), batch["right"][n].as_py(), strict=True))
                most = dict(zip(names, batch["most"][n].as_py(), strict=True))
                ends, places = (_array(batch, c, n) for c in ("pair_ends", "pair_places"))
                starts = np.r_[0, ends][:-1]
                lists = {p: places[s:e] for p, s, e in zip(names, starts.tolist(), ends.tolist(), strict=True) if e > s}
                found: list[tuple] = []
                seen = [0, 0, 0]
                for item, own in queries.items():
                    at, score = max_score(shard, own, most, lists, least.get(item, 1), k, seen)
                    # Equal scores at the end of the list: the smaller doc_ids, null last.
                    ids = [(-s, d is None, d or 0, d) for s, d in zip(score.tolist(), shard.ids.take(pa.array(at)).to_pylist(), strict=True)]
                    found += [(item, d, -s) for s, _, _, d in sorted(ids, key=lambda x: x[:3])[:k]]
                if opened is not None:
                    for counter, n in zip(opened, seen, strict=True):
                        counter.add(n)
                columns = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    return run


def search(index: DataFrame, asked: DataFrame, k: int = 10, opened=None) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` highest-scoring documents with a score above 0.

    ``asked`` are the ``item_id, term`` of ``query_terms``. Equal scores go by doc_id, null ones last. Items
    without terms, or whose terms no document has, give no rows; so does an index without documents. Rows that
    repeat a doc_id are documents of their own. ``opened``: three accumulators that count
    postings opened, looked up and there.
    """
    spark = session_of(index)
    weighted, documents, words = weigh(index, asked)
    # A block's terms come to the driver and go to the tasks: so many, or those of one longer query.
    blocks, every = max(1, -(-weighted.count() // BLOCK_TERMS)), None
    for number in range(blocks):
        own = weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).collect()
        queries: dict[int, dict[str, int]] = {}
        for row in own:
            queries.setdefault(row["item_id"], {})[row["term"]] = row["weight"]
        weights = {row["term"]: row["weight"] for row in own}
        block = spark.sparkContext.broadcast(pickle.dumps((queries, weights)))
        paired = written(map_arrow(index, _pairs(block, documents, words, k), PAIRED), "ranked-pairs")
        near = map_arrow(paired.drop("items", "floors"), _search(block, thresholds(paired, k), documents, words, k, opened), FOUND)
        every = near if every is None else every.unionByName(near)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def thresholds(paired: DataFrame, k: int) -> dict[int, int]:
    """A score that ``k`` documents reach, for each query that has as many: the k-th of those that the shards
    have scored beforehand. One number a query of a block comes to the driver."""
    each = paired.select(F.explode(F.arrays_zip("items", "floors")).alias("q")).select(F.col("q.items").alias("item"), F.explode("q.floors").alias("impact"))
    order = Window.partitionBy("item").orderBy(F.desc("impact"))
    kth = each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).where(F.col("n") == k)
    return {r["item"]: r["impact"] for r in kth.select("item", "impact").collect()}


ORACLE_SQL = """
WITH split AS (
    SELECT row_number() OVER () AS row, doc_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM documents
), counted AS (SELECT row, doc_id, term, count(*) AS tf FROM split GROUP BY ALL
), sizes AS (SELECT row, sum(tf)::BIGINT AS n FROM counted GROUP BY row
), totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM sizes
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, totals GROUP BY term, docs
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM benchmark WHERE item_id IS NOT NULL
), scored AS (
    SELECT item_id, row, doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words))))::BIGINT AS score
    FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN sizes USING (row), totals
    GROUP BY item_id, row, doc_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
