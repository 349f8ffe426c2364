"""Toxicity by compression distance to two zstandard dictionaries.

One dictionary holds what marks toxic text, the other what marks ordinary text: word beginnings and
whole words whose share of documents differs between the classes beyond chance. A text is cut
into windows of a few words, each window is compressed plain and with either dictionary, and the
bytes saved are counted at several thresholds. A logistic model, fitted on labelled documents
the dictionaries have not seen, turns the counts into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollbook.llm.common import chunks, map_arrow, rename_free, session_of

WINDOW_WORDS = 6
# Bounds of the labelled sample that the model is fitted on, in documents of each class.
TOXIC_SAMPLE, ORDINARY_SAMPLE = 2_000, 4_000
DICTIONARY_BYTES = 16_384
LEAST_Z, LEAST_LIFT, LEAST_DOCUMENTS = 3.5, 3.0, 4
SAVED = (3, 4, 5, 6, 8)
REJECT_AT = 0.4
MARKS = re.compile(r"[^\w\s]+")
WORD = re.compile(r"\w+")
# Never matched; stands in for a dictionary with nothing to hold.
BLANK = b"\x00\x01" * 8


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    weights: list[float]


def windows(text: str) -> list[bytes]:
    """The words of the whole text in windows, lower-cased and without punctuation; each window
    stands twice, so that every one is compressible and a saving of few bytes shows."""
    words = MARKS.sub(" ", text.lower()).split()
    cut = [f" {' '.join(words[n : n + WINDOW_WORDS])} ".encode() for n in range(0, len(words), WINDOW_WORDS)]
    return [w + w for w in cut] or [b""]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        3, min_match=6, strategy=zstandard.STRATEGY_LAZY, search_log=6, hash_log=15, chain_log=15,
        window_log=17, write_content_size=0, write_dict_id=0,
    )
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=parameters)


class Features:
    """What both dictionaries save on a text's windows."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.plain, self.toxic, self.ordinary = map(_compressor, (BLANK, toxic, ordinary))

    def of(self, text: str) -> list[float]:
        cut = windows(text)
        plain = np.array([len(self.plain.compress(w)) for w in cut])
        toxic = plain - np.array([len(self.toxic.compress(w)) for w in cut])
        ordinary = plain - np.array([len(self.ordinary.compress(w)) for w in cut])
        second = np.sort(toxic)[-2] if len(toxic) > 1 else 0
        return [
            min(toxic.max(), 12),
            min(second, 6),
            *(np.log1p((toxic >= k).sum()) for k in SAVED),
            *(np.sqrt((toxic >= k).mean()) for k in SAVED[::2]),
            (ordinary >= SAVED[0]).mean(),
            np.log(len(cut)),
        ]


def _beginnings(word: str) -> list[str]:
    return [f" {word[:n]}" for n in range(4, min(len(word), 12) + 1)] + [f" {word} "] * (len(word) > 3)


def contrast(texts: list[str], toxic: np.ndarray) -> dict[str, float]:
    """How far the shares of the classes' documents with a fragment differ, in standard errors;
    positive for toxic. Only fragments that differ by enough are kept."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in zip(texts, toxic, strict=True):
        words = set(WORD.findall(text.lower()))
        counts[int(label)].update({f for w in words for f in _beginnings(w)})
    totals = [int((toxic == k).sum()) for k in (0, 1)]
    out = {}
    for sign, more, less, n, m in ((1, counts[1], counts[0], totals[1], totals[0]), (-1, counts[0], counts[1], totals[0], totals[1])):
        for fragment, seen in more.items():
            if seen >= LEAST_DOCUMENTS:
                a, b = (seen + 0.5) / (n + 1), (less[fragment] + 0.5) / (m + 1)
                if a > LEAST_LIFT * b:
                    z = (a - b) / np.sqrt(a * (1 - a) / max(n, 1) + b * (1 - b) / max(m, 1))
                    if z > LEAST_Z:
                        out[fragment] = sign * z
    return out


def dictionary(scores: dict[str, float], sign: int) -> bytes:
    """The fragments of one class, the most telling last, where matches cost least."""
    held: list[str] = []
    joined, size = "", 0
    for fragment in sorted(scores, key=lambda f: (-sign * scores[f], f)):
        if sign * scores[fragment] > 0 and fragment not in joined:
            size += len(fragment.encode())
            if size > DICTIONARY_BYTES:
                break
            held.append(fragment)
            joined += fragment
    return "".join(reversed(held)).encode().rjust(len(BLANK), b"\x00") or BLANK


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small ridge; the last weight is the
    intercept. Inputs are standardised inside, weights returned for raw inputs."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), 1e-3 * weight.sum() * np.r_[np.ones(x.shape[1]), 0]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(
            (z.T * (weight * p * (1 - p) + 1e-9)) @ z + np.diag(ridge), z.T @ (weight * (p - y)) + ridge * w
        )
        w -= np.clip(step, -5, 5)
    return np.r_[w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum()]


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """Dictionaries from two thirds of the sample, calibration on the rest. With one class only,
    or a class with nothing to calibrate on, the score is the share of toxic documents."""
    fitted = np.arange(len(texts)) % 3 > 0
    scores = contrast([t for t, f in zip(texts, fitted, strict=True) if f], toxic[fitted])
    both = dictionary(scores, 1), dictionary(scores, -1)
    rest = ~fitted
    features = Features(*both)
    x = np.array([features.of(t) for t, r in zip(texts, rest, strict=True) if r])
    y = toxic[rest].astype(float)
    if rest.any() and 0 < y.sum() < len(y):
        return Model(*both, _logistic(x, y, weight[rest]).tolist())
    share = float(np.clip((weight * toxic).sum() / max(weight.sum(), 1e-9), 0.001, 0.999)) if len(toxic) else 0.001
    return Model(*both, [0.0] * (len(SAVED) + 7) + [float(np.log(share / (1 - share)))])


def fit(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic"
) -> Model:
    """Fit on a sample of labelled documents of bounded size, the same one on every run.

    Labels other than 0 and 1 are left out. The sample's classes are weighted back to their
    shares among all labels. One task trains on the sample.
    """
    session_of(documents)
    marked = rename_free(labels, {"doc_id": doc_id, "toxic": label}).where("toxic in (0, 1) and doc_id is not null")
    order = F.xxhash64("doc_id", F.lit(7))
    sample = None
    for value, bound in ((1, TOXIC_SAMPLE), (0, ORDINARY_SAMPLE)):
        some = marked.where(F.col("toxic") == value).withColumn("o", order).orderBy("o", "doc_id").limit(bound)
        sample = some if sample is None else sample.unionByName(some)
    totals = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = rename_free(documents, {"doc_id": doc_id, "text": text}).join(F.broadcast(sample), "doc_id")

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["o", "doc_id"])
        toxic = part["toxic"].to_numpy()
        weight = np.array([totals[v] / (toxic == v).sum() for v in toxic])
        return pd.DataFrame([train([t or "" for t in part["text"]], toxic, weight)._asdict()])

    found = rows.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(one, "toxic binary, ordinary binary, weights array<double>").first()
    if found is None:
        return train([], np.empty(0, int), np.empty(0))
    return Model(bytes(found["toxic"]), bytes(found["ordinary"]), list(found["weights"]))


def score(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` for every row and whole text; null and empty texts are scored as empty.

    Repeated rows are scored alike; null doc_ids stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights = Features(model.toxic, model.ordinary), np.array(model.weights)
        for part in chunks(batches, "text"):
            x = np.array([features.of(t or "") for t in part["text"].to_pylist()])
            values = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"].combine_chunks(), pa.array(values, pa.float64())], ["doc_id", "score"]
            )

    return map_arrow(rename_free(documents, {"doc_id": doc_id, "text": text}), run, "doc_id long, score double")


def keep(documents: DataFrame, model: Model, text: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """The rows, with all their columns, whose score is below ``reject_at``."""
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights = Features(model.toxic, model.ordinary), np.array(model.weights)
        for part in chunks(batches, text):
            x = np.array([features.of(t or "") for t in part[text].to_pylist()])
            values = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield from part.filter(pa.array(values < reject_at)).to_batches()

    return map_arrow(documents, run, schema)
