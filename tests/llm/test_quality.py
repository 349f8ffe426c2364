from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tollbook.llm import quality

START = quality.START


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney straight from its definition."""
    counts = {order: Counter(g for t in texts for s in [START * (order - 1) + t] for g in (s[i : i + order] for i in range(len(t))))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts = {}
    for n, own in counts.items():
        have = [sum(c == k for c in own.values()) for k in (1, 2, 3, 4)]
        y = have[0] / (have[0] + 2 * have[1]) if have[0] else 0.5
        discounts[n] = [
            min(max(k - (k + 1) * y * have[k] / have[k - 1], 0.05), k - 0.05) if have[k - 1] else 0.5 * k**0.5 for k in (1, 2, 3)
        ]
    total, given = defaultdict(Counter), defaultdict(Counter)
    for n, own in counts.items():
        for g, c in own.items():
            total[n][g[:-1]] += c
            given[n][g[:-1]] += discounts[n][min(c, 3) - 1]

    def chance(context, char):
        p = 1 / (len(counts[1]) + 1)
        for n in range(1, order + 1):
            c = context[len(context) - n + 1 :] if n > 1 else ""
            if total[n][c]:
                seen = counts[n][c + char]
                own = seen - discounts[n][min(seen, 3) - 1] if seen else 0
                p = own / total[n][c] + given[n][c] / total[n][c] * p
        return p

    def loglik(text):
        s = START * (order - 1) + text
        return sum(math.log(chance(s[i : i + order - 1], s[i + order - 1])) for i in range(len(text)))

    return loglik


TRUSTED = ["the cat sat on the mat.", "a cat and a dog", "the dog sat", "", None, "naïve cats, 東京", "the the the"]


def test_scores_equal_the_definition(spark, documents):
    docs = documents(list(enumerate(TRUSTED)))
    asked = documents([*enumerate(TRUSTED), (50, "zzz unseen Ω"), (51, "cat"), (None, "dog on mat"), (51, "cat")])
    model = quality.fit(docs)
    got = quality.score(asked, model).collect()
    loglik = plain_model([t or "" for t in TRUSTED], quality.ORDER)
    texts = {r["doc_id"]: r["text"] or "" for r in asked.collect()}
    assert len(got) == asked.count()
    for row in got:
        assert row["loglik"] == pytest.approx(loglik(texts[row["doc_id"]]), rel=1e-4)
        assert row["n"] == len(texts[row["doc_id"]])


def test_junk_goes_and_clean_stays(spark, documents):
    rng = np.random.default_rng(0)
    words = ["river", "stone", "walks", "under", "the", "quiet", "moon", "and", "sings", "softly"]
    clean = [(i, " ".join(rng.choice(words, 40))) for i in range(120)]
    junk = [(1000 + i, " ".join("".join(rng.choice(list("#$%&!QXZJ7"), 6)) for _ in range(30))) for i in range(20)]
    docs = documents([*clean, *junk, (2000, None), (2001, ""), (None, clean[0][1])])
    trusted = spark.createDataFrame([(i,) for i in range(0, 120, 2)] + [(None,), (4,)], "doc_id long")
    kept = quality.keep(docs, trusted)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert not ids & {i for i, _ in junk} and not ids & {2000, 2001}
    assert len(ids & set(range(120))) >= 119 and None in ids


def test_without_trusted_texts_everything_but_empty_stays(spark, documents):
    docs = documents([(1, "some text"), (2, None)])
    trusted = spark.createDataFrame([], "doc_id long")
    assert [r["doc_id"] for r in quality.keep(docs, trusted).collect()] == [1]
    assert quality.classify(documents([]), trusted).count() == 0
