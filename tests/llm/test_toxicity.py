from __future__ import annotations

import numpy as np
import pytest

from tollbook.llm import toxicity


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(6)
    syllables = ["on", "the", "er", "st", "ea", "tion", "ing", "wh", "and", "or"]
    bad = ["wretchling", "grubbard", "snivelton"]

    def text(toxic):
        words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(30, 120))]
        if toxic:
            for at in rng.integers(0, len(words), 4):
                words[at] = rng.choice(bad)
        return " ".join(words)

    return [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(600)]


def test_held_out_accuracy(spark, documents, corpus):
    docs = documents([(i, t) for i, t, _ in corpus])
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in corpus if i % 4 != 2] + [(None, 1, "x"), (9_999, None, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in corpus if i % 4 == 2]
    assert min(s for s, y in held if y) > 0.3 > max(s for s, y in held if not y)
    kept = toxicity.keep(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < toxicity.REJECT_AT}
    # The same rows give the same model.
    assert toxicity.fit(docs.repartition(7), labels) == model


def test_odd_rows(spark, odd, documents):
    labels = spark.createDataFrame([(6, 0), (8, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = toxicity.fit(documents([]), labels)
    assert toxicity.score(documents([]), none).count() == 0
    assert toxicity.score(odd, none).where("score < 0.3").count() == odd.count()


def test_window_covers_the_whole_text():
    words = [f"w{n}" for n in range(20)]
    cut = toxicity.windows(" ".join(words))
    assert b" ".join(c[: len(c) // 2].strip() for c in cut).decode().split() == words
    assert toxicity.windows("") == [b""]
