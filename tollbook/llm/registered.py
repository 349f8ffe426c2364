"""The operators as queries over the sample tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollbook.llm import (
    bm25,
    byte_bpe,
    filter_audit,
    html_main,
    packing,
    pair_maxscore,
    prefix_counts,
    quality,
    secrets,
    set_join,
    toxicity,
    url_templates,
    vp_tree,
)
from tollbook.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digest(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(
        table(spark, sf_dir, "documents"), shared_folder(spark, "secret-ledger"), path="doc_id"
    )
    return secrets.digest(found)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.join(table(spark, sf_dir, "documents"), words=4, percent=85)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = toxicity.fit(documents, labels.where(~held_out))
    return toxicity.score(documents, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.classify(table(spark, sf_dir, "documents"), trusted)


def op2_vp_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return vp_tree.nearest(embeddings, embeddings.where("vec_id % 100 = 0"), k=10)


# The query's rules.
URL_RULES = (
    url_templates.Rule("allow", "org", "/"),
    url_templates.Rule("block", "example.org", "/es/"),
    url_templates.Rule("block", "example.org", "/en/1"),
    url_templates.Rule("allow", "com", "/fr/"),
    url_templates.Rule("block", "com", "/de/"),
)


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    text = html_main.extract(pages, html_main.fit(pages))
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op4_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose doc_id is divisible by 20 asks with all its words."""
    documents = table(spark, sf_dir, "documents")
    queries = documents.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    return bm25.search(bm25.build(documents), queries, k=10)


def op11_pair_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = pair_maxscore.query_terms(table(spark, sf_dir, "benchmark"))
    return pair_maxscore.search(pair_maxscore.build(table(spark, sf_dir, "documents"), asked), asked, k=10)


def op12_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    counts = prefix_counts.prefix_counts(table(spark, sf_dir, "documents"), model, keep_steps=False)
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def llm_queries() -> dict[str, Query]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_vp_tree_neighbours": op2_vp_tree_neighbours,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_bm25_search": op4_bm25_search,
        "op5_secret_scan": op5_secret_scan,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_html_main_text": op7_html_main_text,
        "op8_toxicity": op8_toxicity,
        "op9_url_templates": op9_url_templates,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
        "op11_pair_maxscore": op11_pair_maxscore,
        "op12_prefix_token_counts": op12_prefix_token_counts,
        "op13_filter_audit": op13_filter_audit,
    }


def llm_oracles() -> dict[str, str]:
    return {
        "op9_url_templates": url_templates.oracle_sql(URL_RULES),
        "op11_pair_maxscore": pair_maxscore.ORACLE_SQL,
        "op13_filter_audit": filter_audit.ORACLE_SQL,
    }
