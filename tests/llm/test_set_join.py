from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tollbook.llm import set_join


def plain_set(text, words):
    own = (text or "").encode().lower().split()
    if not own:
        return frozenset()
    return frozenset([tuple(own)]) if len(own) < words else frozenset(zip(*(own[k:] for k in range(words)), strict=False))


def brute(rows, words, percent):
    sets = [plain_set(t, words) for _, t in rows]
    group = list(range(len(rows)))

    def find(n):
        while group[n] != n:
            n = group[n]
        return n

    links = Counter()
    for n, a in enumerate(sets):
        for m in range(n):
            b = sets[m]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[n] += 1
                links[m] += 1
                x, y = find(n), find(m)
                group[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)].append(i)
    return sorted(
        (-1 if i is None else i, len(sets[n]), (min(least[find(n)], default=-1) if sets[n] else (-1 if i is None else i)), links[n])
        for n, (i, _) in enumerate(rows)
    )


def got(frame, words, percent):
    return sorted(
        (-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"], r["n_links"])
        for r in set_join.join(frame, words, percent).collect()
    )


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{n}" for n in range(400)]
    passage = list(rng.choice(vocabulary, 12))
    rows = []
    for base in range(25):
        words = list(rng.choice(vocabulary, rng.integers(6, 90)))
        for _ in range(rng.integers(1, 9)):
            copy = list(words)
            for at in rng.integers(0, len(copy), rng.integers(0, 3)):
                copy[at] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy += passage
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
        rows.append((len(rows) * 3 + 1, " ".join(passage[:8] + [f"x{base}"])))
    rng.shuffle(rows)
    rows += [(9000, None), (9001, ""), (9002, " \t"), (9003, "one two"), (9004, "ONE  two"), (9005, "two one"), (9006, "ONE two é"), (9007, rows[0][1]), (9007, rows[0][1]), (None, rows[0][1]), (None, "alone here")]
    return [(None if i is None else int(i), t) for i, t in rows]


@pytest.mark.parametrize("words, percent, block", [(4, 85, 2_000), (5, 80, 2_000), (4, 85, 3), (2, 60, 4)])
def test_equals_all_pairs(documents, monkeypatch, words, percent, block):
    monkeypatch.setattr(set_join, "BLOCK_SETS", block)
    rows = corpus(words)
    assert got(documents(rows), words, percent) == brute(rows, words, percent)


def test_long_list_and_large_group(documents, monkeypatch):
    """A list beyond what is counted, in pieces, and a group of many near copies."""
    monkeypatch.setattr(set_join, "MOST_COUNTED", 16)
    rng = np.random.default_rng(5)
    base = [f"v{n}" for n in range(60)]
    rows = []
    for n in range(120):
        copy = list(base)
        copy[int(rng.integers(0, 60))] = f"u{n}"
        rows.append((n, " ".join(copy)))
    assert got(documents(rows), 4, 85) == brute(rows, 4, 85)


def test_derived_counts_equal_fresh_ones():
    rng = np.random.default_rng(9)
    sets = sorted((np.unique(rng.integers(0, 80, rng.integers(5, 60))).astype(np.uint64) for _ in range(80)), key=len)
    for n, partners in set_join.links_among(sets, None, 50):
        want = [m for m in range(n) if 100 * len(np.intersect1d(sets[n], sets[m])) >= 50 * len(np.union1d(sets[n], sets[m]))]
        assert partners.tolist() == want


def test_keep_one_and_empty(documents):
    rows = corpus(3)
    kept = set_join.keep_one(documents(rows), 5, 80)
    want = {i for i, _, c, _ in brute(rows, 5, 80) if i == c}
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == documents([]).columns
    assert {i for i in ids if i is not None} == want - {-1} and ids.count(9007) <= 1 and ids.count(None) == 2
    assert set_join.join(documents([])).count() == 0


def test_copies_meet_once(documents, monkeypatch):
    """A cluster's task gets one row for all copies of a text."""
    links = set_join._cluster_links

    def counted(words, percent):
        run = links(words, percent)

        def some(batches):
            held = list(batches)
            if sum(b.num_rows for b in held) > 3:
                raise ValueError("copies travel to a cluster's task")
            yield from run(iter(held))

        return some

    monkeypatch.setattr(set_join, "_cluster_links", counted)
    text = [f"v{n}" for n in range(60)]
    rows = [(n, " ".join(text)) for n in range(80)]
    rows += [(100 + n, " ".join([*text, f"u{n}"])) for n in range(2)]
    assert got(documents(rows), 4, 85) == brute(rows, 4, 85)


def test_pieces_of_a_list_have_one_number():
    rows = [(5, 1)] + [(7, s) for s in (1, 1, 1, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9)] + [(8, 1), (8, 2), (8, 2), (9, 3)]
    for size in range(1, 8):
        batches = [
            pa.RecordBatch.from_pydict({"token": pa.array([t for t, _ in some], pa.int64()), "sid": pa.array([s for _, s in some], pa.int64())})
            for some in (rows[n : n + size] for n in range(0, len(rows), size))
        ]
        out = [r for b in set_join._shared(4)(iter(batches)) for r in b.to_pylist()]
        assert [(r["token"], r["sid"], r["sets"]) for r in out] == [(7, s, 4) for s in range(1, 10)] + [(8, 1, 2), (8, 2, 2)]


def test_short_texts_and_long_lists(spark, documents, monkeypatch):
    """Sets of few shingles, with shingles that more sets have than are counted, in small batches."""
    monkeypatch.setattr(set_join, "MOST_COUNTED", 4)
    rng = np.random.default_rng(2)
    rows = [(n, " ".join(f"p{x}" for x in rng.permutation(10)[: rng.integers(6, 11)])) for n in range(150)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert got(documents(rows), 1, 85) == brute(rows, 1, 85)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_keep_one_goes_by_row(documents):
    """A doc_id on rows with unlinked texts keeps both, and of a component only its smallest."""
    a, b, c = (" ".join(f"{x}{n}" for n in range(30)) for x in "abc")
    kept = set_join.keep_one(documents([(1, a), (2, b), (2, c), (3, b), (5, a), (5, c + " more"), (2, c)]), 5, 80)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, a), (2, b), (2, c)]


def test_large_clusters_do_not_multiply_texts(documents, monkeypatch):
    """Texts that share a passage, not enough to link, do not meet in all pairs of blocks, and texts of sizes too far apart never do."""
    monkeypatch.setattr(set_join, "BLOCK_SETS", 8)
    units, written = [], set_join.written

    def counted(frame, purpose, *folders):
        out = written(frame, purpose, *folders)
        if purpose == "cluster-members":
            units.append(out.count())
        return out

    monkeypatch.setattr(set_join, "written", counted)
    passage = [f"p{n}" for n in range(14)]

    def shared(size):
        return [(n, " ".join([*passage, *(f"u{n}x{k}" for k in range(8 + n % 5))])) for n in range(size)]

    for size in (80, 160):
        rows = shared(size)
        assert got(documents(rows), 4, 85) == brute(rows, 4, 85)
    assert units[1] <= 2 * units[0] + 16 <= 2 * 80 + 16
    # True copies in blocks by size: each block meets only those of like size.
    units.clear()
    word = [f"v{n}" for n in range(400)]
    rows = [(n, " ".join(word[: 20 + 4 * n])) for n in range(90)]
    assert got(documents(rows), 4, 85) == brute(rows, 4, 85)
    assert units[0] < 90 * 6


def test_chains_connect_all_that_may_link():
    """Against all pairs of each list, in batches of every size."""
    rng = np.random.default_rng(3)
    for percent, size in ((80, 1), (85, 3), (60, 7), (80, 400)):
        rows = []
        for token in range(12):
            for sid in rng.permutation(60)[: rng.integers(1, 40)]:
                n = int(rng.integers(5, 60))
                place = int(rng.integers(0, n - -(-percent * n // 100) + 1))
                rows.append((token, n, int(sid) + 100 * token, ((100 + percent) * (n - place) - percent * n) // percent))
        rows.sort(key=lambda r: r[:3])
        batches = [
            pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows[at : at + size]], pa.int64()) for k, c in enumerate(("token", "n", "sid", "most"))})
            for at in range(0, len(rows), size)
        ]
        group = {r[2]: r[2] for r in rows}

        def find(n, group=group):
            while group[n] != n:
                n = group[n]
            return n

        ties = [(r["a"], r["b"]) for b in set_join._chains(percent)(iter(batches)) for r in b.to_pylist()]
        for a, b in ties:
            a, b = find(a), find(b)
            group[max(a, b)] = min(a, b)
        pairs = [(x, y) for n, y in enumerate(rows) for x in rows[:n] if x[0] == y[0] and 100 * x[1] >= percent * y[1]]
        able = [(x[2], y[2]) for x, y in pairs if x[1] <= y[3] and y[1] <= x[3]]
        assert able and all(find(a) == find(b) for a, b in able)
        assert all(a // 100 == b // 100 for a, b in ties) and len(ties) < len(rows)


def test_keep_one_moves_only_rows_that_may_go(spark, documents):
    """Texts of rows that stay go to no shuffle."""
    rows = [(n, f"alone {n} " * 9) for n in range(50)] + [(100 + n, "twice over and over " * 9) for n in range(2)]
    kept = set_join.keep_one(documents(rows), 5, 80)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(50), 100]
    # One branch has no join but the one with the filter's bits.
    assert "Union" in plan and "Join" in plan.split("Union")[1]


def test_stored_steps_leave_no_shuffle_files(tmp_path, spark):
    from pyspark.sql import functions as F

    from tollbook.llm import common

    before = spark.conf.get(common.CLEAN_SETTING)
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    held = tracker.shuffleStatuses().size()
    out = common.written(spark.range(1_000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count(), "clean")
    assert out.count() == 10 and spark.conf.get(common.CLEAN_SETTING) == before
    assert tracker.shuffleStatuses().size() <= held + 1
