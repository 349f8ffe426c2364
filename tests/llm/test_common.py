from __future__ import annotations

import random

import pyarrow as pa
import pytest

from tollbook.llm import common


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + n, 101 + n) for n in range(25)] + [(7, 7), (3, 4), (3, 4)]
    group = {n: n for e in edges for n in e}

    def find(n):
        while group[n] != n:
            n = group[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        group[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r["node"]: r["component"] for r in common.components(frame, "test").collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


@pytest.mark.parametrize("shape", ["path", "clique", "tree"])
def test_rows_written_grow_with_the_nodes_of_a_group(spark, monkeypatch, shape):
    """Stored rows for a group of one, two and four times the size."""
    written, rows = common.written, []

    def counted(frame, purpose):
        out = written(frame, purpose)
        rows.append(out.count())
        return out

    monkeypatch.setattr(common, "written", counted)
    totals = []
    for size in (100, 200, 400):
        rng = random.Random(1)
        nodes = rng.sample(range(1 << 40), size)
        edges = {
            "path": list(zip(nodes, nodes[1:], strict=False)),
            "clique": [(a, b) for n, a in enumerate(nodes) for b in nodes[n + 1 : n + 60]],
            "tree": [(a, nodes[n // 2]) for n, a in enumerate(nodes) if n],
        }[shape]
        rows.clear()
        rng.shuffle(edges)
        got = common.components(spark.createDataFrame(edges, "a long, b long").repartition(16), "test")
        assert {(r["node"], r["component"]) for r in got.collect()} == {(n, min(nodes)) for n in nodes}
        totals.append(sum(rows))
    assert totals[1] < 2.6 * totals[0] and totals[2] < 2.6 * totals[1]


def test_no_edges(spark):
    assert common.components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_prefilter_never_loses_a_key(spark):
    keys = spark.createDataFrame([(f"k{n}",) for n in range(0, 500, 7)] + [(None,)], "key string")
    rows = spark.createDataFrame([(f"k{n}", n) for n in range(2_000)] + [(None, 1)], "key string, n int")
    kept = {r["key"] for r in common.prefilter(rows, "key", keys, "key").collect()}
    assert {f"k{n}" for n in range(0, 500, 7)} <= kept and len(kept) < 100


def test_chunks_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"text": ["abcd", None, "efgh", "x" * 50, "", "ij"]})
    parts = [t["text"].to_pylist() for t in common.chunks(iter([batch, batch.slice(0, 0)]), "text")]
    assert parts == [["abcd", None, "efgh"], ["x" * 50], ["", "ij"]]


def test_workers_get_bounded_batches(spark):
    rows = spark.range(400, numPartitions=1).selectExpr("id", "repeat('x', 100000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64()), "bytes": pa.array([batch.nbytes], pa.int64())})

    spark.conf.unset(common.BATCH_SETTING)
    got = common.map_arrow(rows, sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in got) == 400
    assert max(r["bytes"] for r in got) <= common.BATCH_BYTES + 200_000
    # What the session says holds.
    spark.conf.set(common.BATCH_SETTING, str(1 << 20))
    got = common.map_arrow(rows, sizes, "n long, bytes long").collect()
    assert max(r["bytes"] for r in got) <= 1_300_000
    spark.conf.unset(common.BATCH_SETTING)
