"""The stages against plain versions on a small corpus, and the registered queries' shapes."""

from __future__ import annotations

import re

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from tollbook.llm import packing, registered
from tollbook.llm.common import written

SECRET = "token=abcdefgh12345678"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    syllables = ["on", "the", "er", "st", "ea", "tion", "ing", "wh", "and", "or"]
    bad = ["wretchling", "grubbard", "snivelton"]
    rows, labels = [], []
    for i in range(300):
        words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(20, 60))]
        toxic = i % 5 == 0
        for at in rng.integers(0, len(words), 6 if toxic else 0):
            words[at] = str(rng.choice(bad))
        rows.append((i, " ".join(words), "en", "src", 0))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    rows += [(400 + i, " ".join("".join(rng.choice(list("#$%&!QXZJ7"), 6)) for _ in range(30)), "en", "src", 0) for i in range(15)]
    rows += [(500, rows[1][1], "en", "src", 0), (501, rows[2][1] + " more", "en", None, None), (502, f"{rows[3][1]} and {SECRET}", None, "src", 0), (503, None, "en", "src", 0), (504, "", None, None, None)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_stages(spark, folder):
    path, rows = folder
    texts = {r[0]: r[1] for r in rows}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, path), name)
        after[name] = docs.toPandas()
        assert name == "packing" or docs.columns == columns
    kept = {name: set(frame["doc_id"]) for name, frame in after.items()}
    assert not kept["quality"] & {*range(400, 415), 503, 504} and len(kept["quality"]) >= 302
    toxic = {i for i, t in texts.items() if t and re.search("wretchling|grubbard|snivelton", t)}
    assert not kept["toxicity"] & toxic
    assert len(kept["quality"] - toxic - kept["toxicity"]) <= 3
    assert kept["near_duplicates"] == kept["toxicity"] - {500, 501 if 2 in kept["toxicity"] else -1, 502 if 3 in kept["toxicity"] else -1} | (kept["near_duplicates"] & {502})
    masked = after["secrets"].set_index("doc_id")
    assert not masked["text"].str.contains("abcdefgh12345678").any()
    assert (masked["text"].str.len() == masked["n_chars"]).all()
    packed = after["packing"]
    assert kept["packing"] == kept["secrets"]
    assert packed.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY


def test_run_is_the_stages(spark, folder):
    path, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 200


def test_all_are_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert set(registered.llm_oracles()) <= set(names)
