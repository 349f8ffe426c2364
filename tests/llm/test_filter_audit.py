from __future__ import annotations

import itertools
import os
import random
import re
import uuid

import pytest

from check_oracle import database
from tollbook.llm import filter_audit
from tollbook.llm.registered import op13_filter_audit


def brute(docs, labels, letters="ABCDE"):
    """Applies every order of the filters, step by step, to the documents ``(doc_id, text, part)``."""
    mine = lambda n: {d: max(int(r[n] == 1) for r in labels if r[0] == d) for d in {r[0] for r in labels} - {None}}
    good, toxic = mine(1), mine(2)
    rows = []
    for doc, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs),
        }
        rows.append((part or "", {x for x in letters if fails[x]}, good.get(doc, 0), toxic.get(doc, 0)))
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], dict.fromkeys(letters, 0)
        for order in itertools.permutations(letters):
            left = own
            for step, x in enumerate(order, 1):
                gone, left = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                shapley[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in r[1] for r in own) - len(gone), sum(r[1] == {x} for r in own),
                    sum(r[2] for r in gone), sum(r[3] for r in gone), x,
                ]
        for key, value in out.items():
            if key[0] == part:
                value[6] = shapley[value[6]]
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(5)
    texts = [None, "", " ".join(f"w{n}" for n in range(120)), "a " * 150, "LOUD " + "quiet " * 99, "has # mark", "x" * 30_000, "  \t\n", "Zoë ÉÀ 東京"]
    texts += [" ".join(rng.choice(["Aa", "b$", "c", f"d{n}"]) for n in range(rng.randrange(60, 200))) for _ in range(6)]
    ids = rng.sample(range(1_000), 90)
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in ids] + [(None, "", "en"), (None, texts[2], None)]
    docs += [docs[0], docs[1], docs[1], (docs[2][0], docs[3][1], "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in ids[::2]] + [(ids[0], 1, 0), (None, 1, 1), (5_000, 1, 1)]
    return docs, labels


def stored(spark, tmp_path, docs, files):
    """Documents over several files, larger ids first, with columns whose names clash."""
    path = str(tmp_path / uuid.uuid4().hex)
    docs = sorted(docs, key=lambda d: -(d[0] or 0))
    for n in range(files):
        own = [(*d, "x", b"k", 3) for d in docs[n::files]] if files == 1 else [(*d, "x", b"k", 3) for d in docs[n * len(docs) // files : (n + 1) * len(docs) // files]]
        frame = spark.createDataFrame(own, "doc_id long, text string, lang string, part string, text_key binary, mask int")
        frame.coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize(("files", "batches"), [(1, 4), (6, 3), (6, 6)])
def test_equals_every_order_applied(spark, tmp_path, case, files, batches):
    docs, labels = case
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(spark, stored(spark, tmp_path, docs, files), frame, batches=batches).collect()
    assert {tuple(r[:3]): list(r[3:]) for r in got} == brute(docs, labels)
    assert len(got) == 600 * len({d[2] or "" for d in docs})


def test_smaller_ids_take_back_what_was_counted(spark, tmp_path):
    docs = [(2**60 - n, "same text", "en") for n in range(6)]
    path = stored(spark, tmp_path, docs, 6)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    masks = filter_audit.count_masks(filter_audit.file_stream(spark, path, 6), none)
    assert {(r["part"], r["mask"]): r["n"] for r in masks.collect()} == {("en", 1): 1, ("en", 1 | 16): 5}


def test_empty_table_and_single_file(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark, stored(spark, tmp_path, [], 1), none).count() == 0
    folder = stored(spark, tmp_path, [(1, "a b", "en"), (2, "a b", "en")], 1)
    [file] = [f for f in os.listdir(folder) if f.endswith(".parquet")]
    got = filter_audit.audit(spark, f"{folder}/{file}", none).collect()
    assert {tuple(r[:3]): list(r[3:]) for r in got} == brute([(1, "a b", "en"), (2, "a b", "en")], [])


def test_query_equals_its_sql(spark):
    from check_oracle import compare

    sf_dir = "/root/testdata/sf0.001"
    assert compare(spark, database(sf_dir), sf_dir, op13_filter_audit, filter_audit.ORACLE_SQL) == []
