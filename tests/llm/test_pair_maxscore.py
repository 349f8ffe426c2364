from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from tollbook.llm import pair_maxscore

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """``(item, rank, doc_id, score)`` from the definition."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    asked: dict = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in asked.items():
        found = []
        for doc, c in held:
            m = 10 + (90 * sum(c.values()) * n) // total
            score = sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=10, **kwargs):
    queries = spark.createDataFrame(items, "item_id long, text string")
    asked = pair_maxscore.query_terms(queries)
    index = pair_maxscore.build(docs, asked)
    return sorted(map(tuple, pair_maxscore.search(index, asked, k, **kwargs).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("shard", [3, 8_192])
def test_equals_the_definition(spark, documents, monkeypatch, seed, shard):
    monkeypatch.setattr(pair_maxscore, "SHARD_DOCS", shard)
    rng = random.Random(seed)
    words = [f"w{n}" for n in range(30)] + ["Émile", "2024", "東京", "THE"]
    weights = [1 / (n + 1) for n in range(len(words))]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(n, text(rng.randrange(0, 40))) for n in range(80)]
    docs += [(200 + n, docs[5][1]) for n in range(15)] + [(7, docs[7][1]), (None, "w1 w2 w20"), (300, None), (301, ""), (302, "!!")]
    items = [(n, text(rng.randrange(1, 15))) for n in range(12)] + [(50, None), (51, "nowhere"), (None, "w1"), (3, "w29 w28")]
    assert run(spark, documents(docs).repartition(3), items) == brute(docs, items)


def test_every_term_without_a_limit_and_blocks_of_queries(spark, documents, monkeypatch):
    docs = [(n, f"a{n % 3} b{n % 5} c{n % 7} common") for n in range(40)]
    items = [(n, f"a{n % 3} c{n % 7}") for n in range(9)]
    expected = brute(docs, items, k=4)
    assert run(spark, documents(docs), items, k=4) == expected
    monkeypatch.setattr(pair_maxscore, "MOST_TERMS", 2)
    monkeypatch.setattr(pair_maxscore, "BLOCK_TERMS", 5)
    assert run(spark, documents(docs), items, k=4) == expected


def test_empty_tables(spark, documents):
    assert run(spark, documents([]), [(1, "a")]) == []
    assert run(spark, documents([(1, "a")]), []) == []
    assert run(spark, documents([(1, None), (2, "?")]), [(1, "a")]) == []


def test_very_long_text(spark, documents):
    docs = [(1, "word " * 50_000 + "rare"), (2, "rare word"), (3, "word")]
    assert run(spark, documents(docs), [(1, "rare word")]) == brute(docs, [(1, "rare word")])


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold_and_pairs_keep_more_lists_closed(seed):
    """Every plan against all subsets of lists: what stays closed never reaches the threshold."""
    rng = random.Random(seed)
    for _ in range(60):
        terms = {t: rng.randrange(1, 40) for t in "abcdefg"}
        lists = {t: {d: rng.randrange(1, 1 + w) for d in range(60) if rng.random() < 1 / (1 + w / 6)} for t, w in terms.items()}
        lists = {t: x for t, x in lists.items() if x}
        pairs = pair_maxscore.partners(terms)
        most = {(t, t): max(x.values()) for t, x in lists.items()}
        joint = {(a, b): lists.get(a, {}).keys() & lists.get(b, {}).keys() for a, b in pairs}
        most |= {(a, b): max(lists[a][d] + lists[b][d] for d in docs) for (a, b), docs in joint.items() if docs}
        least = rng.randrange(5, 80)
        sizes, bound = {t: len(x) for t, x in lists.items()}, {t: most[t, t] for t in lists}
        closed, below, paired = pair_maxscore.plan(pairs, sizes, bound, most, least, [p for p in joint if rng.random() < 0.8])
        alone = pair_maxscore.plan([], sizes, bound, most, least)[0]
        assert len(closed) >= len(alone) and closed[: len(alone)] == alone
        found = {d for t in lists.keys() - set(closed) - paired.keys() for d in lists[t]} | {d for p in paired.values() for d in joint[p]}
        score = lambda d, some: sum(lists[t].get(d, 0) for t in some)
        for d in range(60):
            assert d in found or score(d, lists) < least
            assert all(score(d, closed[:n]) <= below[n] for n in range(len(below)))


def test_pairs_open_fewer_postings(monkeypatch):
    """The sample's own items in one shard, with and without pairs: same results, fewer postings opened."""
    docs, items = (pq.read_table(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "benchmark"))
    monkeypatch.setattr(pair_maxscore, "SHARD_DOCS", 100_000)
    monkeypatch.setattr(pair_maxscore, "SHARD_POSTINGS", 1 << 30)
    batch = docs.select(["doc_id", "text"]).slice(0, 4_000).combine_chunks().to_batches()
    [made] = pair_maxscore._index(None)(iter(batch))
    [row] = pair_maxscore._shard_rows(made)
    n, total = len(row["lengths"]), int(row["lengths"].sum())
    sizes = dict(zip(row["terms"], [b - a for a, b in zip([0, *row["ends"].tolist()], row["ends"].tolist(), strict=False)], strict=True))
    weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in sizes.items()}
    shard = pair_maxscore.Shard(row, weights, n, total)
    opened = {}
    plan = pair_maxscore.plan
    for name, own_plan in (("pairs", plan), ("alone", lambda pairs, *rest: plan([], *rest))):
        monkeypatch.setattr(pair_maxscore, "plan", own_plan)
        seen, found = [0, 0, 0], []
        for text in items["text"].to_pylist():
            own = {t: weights[t] for t in set(terms(text)) if t in weights}
            most, lists = {(t, t): int(shard.list(t)[1].max()) for t in own}, {}
            for pair in pair_maxscore.partners(own):
                places, joint = pair_maxscore.both(shard.list(pair[0]), shard.list(pair[1]))
                if len(places):
                    lists[pair], most[pair] = places, int(joint.max())
            full = pair_maxscore.max_score(shard, own, most, lists, 1, 10, [0, 0, 0])[1]
            least = int(sorted(full)[-10] * 0.9)
            found.append(sorted(pair_maxscore.max_score(shard, own, most, lists, least, 10, seen)[1].tolist())[-10:])
        opened[name] = seen[0], seen[2], found
    assert opened["pairs"][2] == opened["alone"][2]
    assert opened["pairs"][0] < 0.9 * opened["alone"][0] < 0.5 * opened["alone"][1]
