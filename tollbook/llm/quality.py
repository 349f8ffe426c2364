"""Quality classifier: an interpolated modified Kneser-Ney model of characters.

N-gram counts of the trusted texts are summed by Spark into one table of discounted
probabilities and back-off weights, a row per n-gram. To score, documents are taken in blocks; the
distinct n-grams of each block join that table, what was found goes back to its block, and every
document's perplexity follows from the whole text. Each language keeps what lies below a high
quantile of the perplexity of its own trusted texts that were not counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollbook.llm.common import chunks, map_arrow, prefilter, rename_free, session_of, written

ORDER = 4
# Stands in front of a text, where a context would reach beyond its beginning.
START = "\x02"
# Characters of text in a block, of which a task holds one, and in a part that is counted at once.
BLOCK_CHARS, PART_CHARS = 12_000_000, 1_500_000
# Characters at a language's mean that a text is extended by, so that few characters decide little.
SMOOTHING_CHARS = 40
KEPT_QUANTILE = 0.995
# Room above the quantile, as a factor of perplexity.
SLACK = 1.1
# One trusted document in so many sets the thresholds and is left out of the counts, because a text
# that was counted looks better than one that was not.
HELD_OUT = 5
DENSE_CODES = 1 << 23


class Grams:
    """Distinct n-grams of some texts, of each order up to ``order``, with the one that ends at
    every character. Ids run through orders from the lowest."""

    def __init__(self, texts: list[str], order: int):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.joined = "".join(START * (order - 1) + t for t in texts)
        codes = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(self.lengths + order - 1) - self.lengths
        # The positions of real characters.
        shift = (starts - np.cumsum(self.lengths) + self.lengths).astype(np.int32)
        self.at = np.repeat(shift, self.lengths) + np.arange(self.lengths.sum(), dtype=np.int32)
        char, letters = self._dense(codes.astype(np.int32), int(codes.max(initial=0)) + 1)
        del codes
        self.ids, self.last, ends = [char], [], letters
        for _ in range(1, order):
            kind = np.int32 if ends * letters < 1 << 31 else np.int64
            wide = self.ids[-1][:-1].astype(kind) * kind(letters) + char[1:]
            own, ends = self._dense(wide, ends * letters)
            self.ids.append(np.r_[np.int32(0), own])
        for n, ids in enumerate(self.ids, 1):
            # A position where each n-gram ends, only of those that end at a real character or
            # stand before one.
            last = np.full(int(ids.max(initial=-1)) + 1, -1, np.int64)
            if n < order:
                last[ids[np.maximum(self.at - 1, 0)]] = np.maximum(self.at - 1, 0)
            last[ids[self.at]] = self.at
            self.last.append(last)

    @staticmethod
    def _dense(codes: np.ndarray, most: int) -> tuple[np.ndarray, int]:
        if most <= DENSE_CODES:
            present = np.zeros(most, bool)
            present[codes] = True
            number = np.cumsum(present, dtype=np.int32) - np.int32(1)
            return number[codes], int(number[-1]) + 1 if most else 0
        found, inverse = np.unique(codes, return_inverse=True)
        return inverse.astype(np.int32), len(found)

    def text_of(self, order: int) -> tuple[np.ndarray, list[str]]:
        ids = np.flatnonzero(self.last[order - 1] >= 0)
        return ids, [self.joined[max(0, e - order + 1) : e + 1] for e in self.last[order - 1][ids].tolist()]


def _counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            grams = Grams([t or "" for t in part["text"].to_pylist()], order)
            if len(grams.at):
                ids, text = grams.text_of(order)
                count = np.bincount(grams.ids[order - 1][grams.at], minlength=int(ids.max()) + 1)[ids]
                yield pa.RecordBatch.from_pydict({"gram": pa.array(text), "count": pa.array(count, pa.int64())})

    return run


def fit(texts: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """The model as a table ``gram, alpha, gamma``: the discounted probability of the last
    character given those before it, and the weight of the lower order after the n-gram.

    The row of the empty n-gram also has in ``alpha`` the uniform probability below the lowest
    order. Null and empty texts add nothing; without any text the table has that row alone.
    """
    spark = session_of(texts)
    counted = map_arrow(rename_free(texts, {"text": text}), _counts(order), "gram string, count long")
    level = written(counted.groupBy("gram").agg(F.sum("count").alias("count")), "ngram-counts")
    levels = {order: level}
    for n in range(order - 1, 0, -1):
        # Below the highest order an n-gram counts once for every character seen before it.
        level = level.groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("count"))
        levels[n] = written(level, "ngram-counts")
    model = None
    for n, own in levels.items():
        # Four sums for an order: how many n-grams were counted once to four times.
        have = own.agg(*(F.count(F.when(F.col("count") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
        ones, *more = (have[f"n{k}"] for k in (1, 2, 3, 4))
        y = ones / (ones + 2 * more[0]) if ones else 0.5
        below = [ones, *more]
        discount = [
            min(max(k - (k + 1) * y * below[k] / below[k - 1], 0.05), k - 0.05) if below[k - 1] else 0.5 * k ** 0.5
            for k in (1, 2, 3)
        ]
        size = F.least(F.col("count"), F.lit(3))
        cut = F.element_at(F.array(*map(F.lit, discount)), size.cast("int"))
        own = own.withColumn("context", F.substring("gram", 1, n - 1)).withColumn("cut", cut)
        sums = own.groupBy("context").agg(F.sum("count").alias("total"), F.sum("cut").alias("given"))
        event = own.join(sums, "context").select(
            "gram", ((F.col("count") - F.col("cut")) / F.col("total")).alias("alpha"), F.lit(None).cast("double").alias("gamma")
        )
        context = sums.select(
            F.col("context").alias("gram"), F.lit(None).cast("double").alias("alpha"), (F.col("given") / F.col("total")).alias("gamma")
        )
        both = event.unionByName(context)
        model = both if model is None else model.unionByName(both)
    letters = levels[1].count()
    lowest = spark.range(1).select(
        F.lit("").alias("gram"), F.lit(1.0 / (letters + 1)).alias("alpha"), F.lit(None if letters else 1.0).cast("double").alias("gamma")
    )
    return written(
        model.unionByName(lowest).groupBy("gram").agg(F.max("alpha").alias("alpha"), F.max("gamma").alias("gamma")), "ngram-model"
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[str]]]:
    """Numbered blocks of a task's rows: ``(block, rows, texts)``."""
    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
    rows, texts, size = [], [], 0
    for part in chunks(batches, "text"):
        for row, text in zip(part.drop(["text"]).to_pylist(), part["text"].to_pylist(), strict=True):
            rows.append(row)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= BLOCK_CHARS:
                yield first, rows, texts
                first, rows, texts, size = first + 1, [], [], 0
    if rows:
        yield first, rows, texts


def _parts(texts: list[str], order: int) -> Iterator[tuple[int, Grams]]:
    """A block's texts some at a time, always cut alike: the first one's place and the n-grams."""
    start = size = 0
    for n, text in enumerate(texts):
        size += len(text)
        if size >= PART_CHARS or n + 1 == len(texts):
            yield start, Grams(texts[start : n + 1], order)
            start, size = n + 1, 0


def _numbered(grams: Grams, order: int, numbers: dict[str, int]) -> list[np.ndarray]:
    """Numbers of a part's n-grams by order and id, in a block's numbering, which grows."""
    out = []
    for n in range(1, order + 1):
        ids, texts = grams.text_of(n)
        own = np.zeros(len(grams.last[n - 1]), np.int32)
        own[ids] = [numbers.setdefault(t, len(numbers)) for t in texts]
        out.append(own)
    return out


def _requests(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in _blocks(batches):
            numbers = {"": 0}
            for _, grams in _parts(texts, order):
                _numbered(grams, order, numbers)
            names = list(numbers)
            for start in range(0, len(names), 50_000):
                own = names[start : start + 50_000]
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([block] * len(own), pa.int64()),
                        "number": pa.array(range(start, start + len(own)), pa.int32()),
                        "gram": pa.array(own, pa.string()),
                    }
                )

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=5)
    for block, rows, texts in _blocks(batches):
        sizes = np.array([len(t.encode()) for t in texts], np.int64)
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array([block], pa.int64()),
                "doc_id": pa.array([[r["doc_id"] for r in rows]], pa.list_(pa.int64())),
                "lang": pa.array([[r["lang"] for r in rows]], pa.list_(pa.string())),
                "content": pa.array([[r["content"] for r in rows]], pa.list_(pa.int64())),
                "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "texts": pa.array([pack.compress("".join(texts).encode())], pa.binary()),
            }
        )


def log_likelihood(grams: Grams, numbers: list[np.ndarray], alpha: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Sum of natural log probabilities of each text's characters. ``alpha`` and ``gamma`` by the
    block's numbers, the empty n-gram first; NaN where the model has no such n-gram."""
    alpha, gamma = np.nan_to_num(alpha, nan=0.0), np.nan_to_num(gamma, nan=1.0)
    chance = np.full(len(grams.at), alpha[0] if alpha[0] > 0 else 1e-6)
    weight = np.full(len(grams.at), gamma[0])
    for ids, number in zip(grams.ids, numbers, strict=True):
        chance = alpha[number[ids[grams.at]]] + weight * chance
        # The next order's context ends one character earlier.
        weight = gamma[number[ids[np.maximum(grams.at - 1, 0)]]]
    own = np.repeat(np.arange(len(grams.lengths)), grams.lengths)
    return np.bincount(own, np.log(chance), len(grams.lengths)).astype(float)


def _scores(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                raw = unpack.decompress(one["texts"][0].as_py())
                ends = np.cumsum(one["sizes"][0].values.to_numpy())
                texts = [raw[a:b].decode() for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]
                found = one["found"][0].values
                at = found.field("number").to_numpy(zero_copy_only=False)
                alpha = np.full(int(at.max(initial=0)) + 1, np.nan)
                gamma = alpha.copy()
                alpha[at] = found.field("alpha").to_numpy(zero_copy_only=False)
                gamma[at] = found.field("gamma").to_numpy(zero_copy_only=False)
                numbers, loglik = {"": 0}, []
                for _, grams in _parts(texts, order):
                    own = _numbered(grams, order, numbers)
                    short = len(numbers) - len(alpha)
                    if short > 0:
                        alpha, gamma = (np.r_[x, np.full(short, np.nan)] for x in (alpha, gamma))
                    loglik.append(log_likelihood(grams, own, alpha, gamma))
                if len(numbers) != one["grams"][0].as_py():
                    raise ValueError("documents changed between two reads; score a stored table")
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": one["doc_id"][0].values,
                        "lang": one["lang"][0].values,
                        "content": one["content"][0].values,
                        "n": pa.array([len(t) for t in texts], pa.int64()),
                        "loglik": pa.array(np.concatenate(loglik), pa.float64()),
                    }
                )

    return run


def score(
    documents: DataFrame, model: DataFrame, order: int = ORDER,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """``doc_id, lang, content, n, loglik`` for every row and whole text; a null text is the empty one.
    ``content`` is a hash of text and language, on which all else depends.

    ``documents`` must give the same rows in the same partitions each time it is read, as a stored
    table does.
    """
    rows = rename_free(documents, {"doc_id": doc_id, "lang": lang, "text": text})
    rows = rows.withColumn("content", F.xxhash64("text", "lang"))
    wanted = map_arrow(rows, _requests(order), "block long, number int, gram string")
    held = F.struct("number", F.col("alpha").cast("float").alias("alpha"), F.col("gamma").cast("float").alias("gamma"))
    found = (
        wanted.join(model, "gram", "left")
        .groupBy("block")
        .agg(
            # What the model lacks is known by its absence.
            F.collect_list(F.when(F.coalesce("alpha", "gamma").isNotNull(), held)).alias("found"),
            F.count("*").alias("grams"),
        )
    )
    packed = map_arrow(rows, _packed, "block long, doc_id array<long>, lang array<string>, content array<long>, sizes array<long>, texts binary")
    return map_arrow(packed.join(found, "block"), _scores(order), "doc_id long, lang string, content long, n long, loglik double")


def judge(scored: DataFrame, trusted: DataFrame, quantile: float = KEPT_QUANTILE) -> DataFrame:
    """Adds ``perplexity``, the language's ``threshold`` and ``keep`` to ``score``'s rows.

    The threshold is the ``quantile`` of the trusted documents' perplexity in the language times
    ``SLACK``, null being a language too; where a language has no trusted text, that of all trusted ones. Texts are
    extended by ``SMOOTHING_CHARS`` characters at the mean of their language. Without
    trusted texts everything is kept. Empty texts have no perplexity and are not kept.
    """
    marked = scored.join(
        trusted.select(F.col("doc_id")).where("doc_id is not null").distinct().withColumn("trusted", F.lit(True)), "doc_id", "left"
    )
    own = marked.where("trusted and n > 0")
    mean = (-F.sum("loglik") / F.sum("n")).alias("mean")
    means, over = own.groupBy("lang").agg(mean), own.agg(mean)
    level = lambda m: (-F.col("loglik") + SMOOTHING_CHARS * m) / (F.col("n") + SMOOTHING_CHARS)
    means = means.crossJoin(F.broadcast(over.withColumnRenamed("mean", "overall")))
    smooth = marked.join(F.broadcast(means.withColumnRenamed("lang", "l")), F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")
    smooth = smooth.crossJoin(F.broadcast(over.withColumnRenamed("mean", "fallback"))).drop("overall")
    smooth = smooth.withColumn("level", F.when(F.col("n") > 0, level(F.coalesce("mean", "fallback", F.lit(0.0)))))
    limits = smooth.where("trusted and n > 0").groupBy(F.col("lang").alias("l")).agg(
        F.percentile_approx("level", quantile, 10_000).alias("limit")
    )
    all_limit = smooth.where("trusted and n > 0").agg(F.percentile_approx("level", quantile, 10_000).alias("any_limit"))
    judged = (
        smooth.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")
        .crossJoin(F.broadcast(all_limit))
        .withColumn("limit", F.coalesce("limit", "any_limit", F.lit(float("inf"))))
    )
    return judged.select(
        "doc_id", "lang", "content", F.col("n").alias("n_chars"), F.exp("level").alias("perplexity"),
        (F.exp("limit") * SLACK).alias("threshold"),
        F.coalesce(F.exp("level") <= F.exp("limit") * SLACK, F.lit(False)).alias("keep"),
    )


def classify(
    documents: DataFrame, trusted: DataFrame, order: int = ORDER, quantile: float = KEPT_QUANTILE,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """Train on the texts of ``trusted`` doc_ids and judge every document by those held out.

    Returns ``doc_id, lang, content, n_chars, perplexity, threshold, keep``, one row per input row.
    """
    ids = trusted.select(F.col(f"`{doc_id}`").alias("doc_id")).where("doc_id is not null").distinct()
    held_out = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(HELD_OUT)) == 0
    counted = ids.where(~held_out)
    texts = rename_free(documents, {"doc_id": doc_id, "text": text})
    # The same join at every size, whatever the ids would let Spark broadcast.
    own = prefilter(texts, "doc_id", counted, "doc_id").join(counted.hint("merge"), "doc_id", "left_semi")
    model = fit(own, order=order)
    scored = written(score(documents, model, order, doc_id, text, lang), "quality-scores")
    return judge(scored, ids.where(held_out), quantile)


def keep(
    documents: DataFrame, trusted: DataFrame, order: int = ORDER, quantile: float = KEPT_QUANTILE,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """The rows, with all their columns, that ``classify`` keeps."""
    judged = classify(documents, trusted, order, quantile, doc_id, text, lang)
    rejected = judged.where("not keep").select("content").distinct()
    rows = documents.select(F.struct("*").alias("row"), F.xxhash64(f"`{text}`", f"`{lang}`").alias("content"))
    return rows.join(rejected, "content", "left_anti").select("row.*")
