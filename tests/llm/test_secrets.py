from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tollbook.llm import secrets
from tollbook.session import shared_folder

KEY = "AKIA" + "ABCD1234EFGH5678"
TEXT = f"""Password = 'hunter2hunter2' é {KEY} token:short api_key: "{"0123456789abcdef" * 3}" end"""


def plain(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, k, b in sorted(found)]


PARTS = st.sampled_from(["password", "PASSWD", "secret", "token", "api_key", "ApiKey", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGH12", "0123456789abcdef", "é", "\n", "ſ", "x.y", "-"])


@settings(max_examples=200, deadline=None)
@given(st.lists(PARTS, max_size=25).map("".join))
def test_base_spans(text):
    rules = list(secrets.compiled(secrets.RULES).values())
    found = [(k.split("@")[0], a, b) for k, a, b in secrets.find(text, rules)]
    order = {k: n for n, k in enumerate(secrets.BASE)}
    base = sorted((f for f in found if f[0] in order), key=lambda f: (f[1], order[f[0]]))
    assert base == plain(text)


def test_digest_rows(spark, odd, documents):
    docs = odd.unionByName(documents([(20, TEXT), (21, TEXT), (22, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.abcdefghijk ghp_" + "a1" * 20)]))
    got = secrets.digest(secrets.findings(docs, shared_folder(spark, "ledger"), path="doc_id")).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for key, row in by_id.items():
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(texts[key]))
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
    assert by_id[20]["n_assign"] == 2 and by_id[20]["n_access"] == 1 and by_id[20]["n_hex"] == 1
    assert "jwt:0:" in by_id[22]["spans"] and "github:" in by_id[22]["spans"]


def test_ledger_scans_only_what_is_new(spark, documents):
    folder = shared_folder(spark, "ledger")
    secrets.findings(documents([(1, TEXT), (2, TEXT), (3, "clean")]), folder, path="doc_id")
    seen = spark.read.parquet(folder)
    assert seen.count() == 2
    secrets.findings(documents([(1, TEXT), (4, "clean"), (5, "secret=abcdefgh1")]), folder, path="doc_id")
    assert spark.read.parquet(folder).count() == 3
    # A new version of one rule is the only one that reads the blobs again.
    rules = tuple(r._replace(version=2, least=40) if r.kind == "hex" else r for r in secrets.RULES)
    found = secrets.findings(documents([(1, TEXT), (6, None)]), folder, rules, path="doc_id").collect()
    again = [r["scanned"] for r in spark.read.parquet(folder).collect()]
    assert again.count(["hex@2"]) == 1
    spans = {r["path"]: r["spans"] for r in found}
    assert {s["kind"] for s in spans[1]} == {"assign", "access", "hex"} and spans[6] is None


def test_redact(spark, documents):
    docs = documents([(1, TEXT), (2, None), (3, "clean"), (None, TEXT)])
    out = secrets.redact(docs, shared_folder(spark, "ledger"), path="doc_id")
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[2] is None and texts[3] == "clean"
    assert texts[1] == texts[None] == "[assign]' é [access] token:short [assign]\" end"
    assert secrets.masked("abcdef", [(1, 4, "x"), (2, 5, "y")]) == "a[x]f"


def test_empty(spark, documents):
    assert secrets.findings(documents([]), shared_folder(spark, "ledger"), path="doc_id").count() == 0
    with pytest.raises(re.error):
        secrets.compiled((secrets.RULES[0]._replace(pattern="(bad"),))
