"""Secret scans over every historical version, each distinct content scanned once a rule version.

Versions are content-addressed by SHA-256. A ledger folder keeps, for every blob, which rule
versions have read it and what they found, so a scan reads only the blob and rule-version pairs
that the ledger lacks; findings then join back to all paths that hold the blob.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollbook.llm.common import chunks, map_arrow, prefilter, rename_free, session_of


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    group: int  # whose length counts
    least: int  # code points
    needles: tuple[str, ...]  # one of them is in every lower-cased text with a match; empty: none known
    flags: int = re.ASCII

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, then rules for tokens of well-known forms.
RULES = (
    Rule(
        "assign",
        1,
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
        ("password", "passwd", "secret", "token", "api_key", "apikey"),
        re.ASCII | re.IGNORECASE,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]+", 0, 32, ()),
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1, ("private key-----",)),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]+", 0, 20, ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, ("eyj",)),
)
BASE = ("assign", "access", "hex")
FOUND = "array<struct<rule:string,start:int,end:int>>"
LEDGER = f"blob binary, scanned array<string>, found {FOUND}"
# A run of the single-class rules is found faster with its length in the pattern; same matches.
RUN = re.compile(r"^(\[[^]]+\])\+$")


def compiled(rules: tuple[Rule, ...]) -> dict[str, tuple[Rule, re.Pattern]]:
    return {
        r.key: (r, re.compile(RUN.sub(rf"\1{{{r.least},}}", r.pattern), r.flags)) for r in rules
    }


def find(text: str, rules: list[tuple[Rule, re.Pattern]]) -> list[tuple[str, int, int]]:
    """``(rule key, start, end)`` of the leftmost matches of each rule that are long enough."""
    low = text.lower()
    return [
        (rule.key, match.start(), match.end())
        for rule, pattern in rules
        if not rule.needles or any(needle in low for needle in rule.needles)
        for match in pattern.finditer(text)
        if match.end(rule.group) - match.start(rule.group) >= rule.least
    ]


def address(versions: DataFrame, path: str, text: str) -> DataFrame:
    """``path, blob, text``: the content address of each version; a null text is the empty one."""
    wanted = rename_free(versions, {"path": path, "text": text})
    wanted = wanted.withColumn("text", F.coalesce("text", F.lit("")))
    return wanted.select("path", F.unhex(F.sha2("text", 256)).alias("blob"), "text")


def _ledger(frame: DataFrame, folder: str) -> DataFrame | None:
    try:
        return session_of(frame).read.schema(LEDGER).parquet(folder)
    except AnalysisException as absent:
        if "PATH_NOT_FOUND" not in str(absent):
            raise
        return None


def update_ledger(
    versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, path: str = "path", text: str = "text"
) -> None:
    """Scan what the ledger in ``folder`` lacks and append it. A second run over the same rows
    reads no text again. One writer at a time."""
    addressed = address(versions, path, text)
    known = _ledger(versions, folder)
    keys = [rule.key for rule in rules]
    wanted = F.lit(keys) if keys else F.array().cast("array<string>")
    if known is None:
        pending = addressed.groupBy("blob").agg(F.first("text").alias("text")).withColumn("rules", wanted)
    else:
        scanned = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("done"))
        unseen = (
            addressed.select("blob").distinct().join(scanned, "blob", "left")
            .withColumn("rules", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))))
            .where(F.size("rules") > 0).drop("done")
        )
        texts = prefilter(addressed, "blob", unseen, "blob").groupBy("blob").agg(F.first("text").alias("text"))
        pending = texts.join(unseen, "blob")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key = compiled(rules)
        for part in chunks(batches, "text"):
            todo = part["rules"].to_pylist()
            found = [
                [dict(zip(("rule", "start", "end"), x, strict=True)) for x in find(t, [by_key[k] for k in some])]
                for t, some in zip(part["text"].to_pylist(), todo, strict=True)
            ]
            kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [part["blob"].combine_chunks(), part["rules"].combine_chunks(), pa.array(found, kind)],
                ["blob", "scanned", "found"],
            )

    map_arrow(pending, scan, LEDGER).write.mode("append").parquet(folder)


def _of_blobs(versions: DataFrame, folder: str, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, spans`` of the blobs with findings under the current rules."""
    order = F.create_map(*(F.lit(x) for n, r in enumerate(rules) for x in (r.key, n)))
    kinds = F.create_map(*(F.lit(x) for r in rules for x in (r.key, r.kind)))
    return (
        _ledger(versions, folder)
        .select("blob", F.explode("found").alias("f"))
        .where(F.col("f.rule").isin([r.key for r in rules]))
        .distinct()
        .groupBy("blob")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("f.start", order[F.col("f.rule")].alias("order"), kinds[F.col("f.rule")].alias("kind"), "f.end")
                )
            ).alias("spans")
        )
    )


def findings(
    versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, path: str = "path", text: str = "text"
) -> DataFrame:
    """One row for each version: ``path, blob, spans``, the spans as ``start, order, kind, end``
    structs by start and then by the order of the rules. Brings the ledger up to date first.

    Null and empty texts have no spans. Equal rows stay, a row each. An empty table gives no rows.
    """
    update_ledger(versions, folder, rules, path, text)
    addressed = address(versions, path, text).select("path", "blob")
    return addressed.join(_of_blobs(versions, folder, rules), "blob", "left")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each found stretch replaced by ``[kind]``, overlapping ones by the first's."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(
    versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, path: str = "path", text: str = "text"
) -> DataFrame:
    """The rows, with all their columns, and the found stretches of the text masked."""
    update_ledger(versions, folder, rules, path, text)

    def mask(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series(
            [
                t if s is None or not len(s) else masked(t, [(x["start"], x["end"], x["kind"]) for x in s])
                for t, s in zip(texts, spans, strict=True)
            ],
            dtype="object",
        )

    content = F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))
    rows = versions.select(F.struct("*").alias("row"), content.alias("blob"))
    rows = rows.join(_of_blobs(versions, folder, rules), "blob", "left")
    new = F.when(F.col("spans").isNotNull(), F.pandas_udf(mask, "string")(F.col(f"row.`{text}`"), "spans"))
    return rows.select("row.*", new.alias("_masked")).select(
        *(F.coalesce("_masked", f"`{c}`").alias(c) if c == text else F.col(f"`{c}`") for c in versions.columns)
    )


def digest(found: DataFrame) -> DataFrame:
    """Per version: counts of the base kinds, a hash of the base spans, and all spans as text."""
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>"))

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(some):
        return F.array_join(
            F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    base = joined(F.filter(spans, lambda s: s["kind"].isin(*BASE)))
    return found.select(
        F.col("path").alias("doc_id"), *map(count, BASE), F.sha2(base, 256).alias("base_sha256"), joined(spans).alias("spans")
    )
