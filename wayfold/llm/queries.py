"""Registered queries of this subpackage: one per operator, and the pipeline."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import (
    alignment, ann_forest, merkle, mixing, nn_descent, quality, repeats, sentencepiece_wfst, simhash, token_counts, token_files,
    toxicity, warc,
)
from wayfold.llm.common import table
from wayfold.session import fresh_dir

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file: of the installed package, else below PUBLIC_TOKENIZERS."""
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return f"{TOKENIZERS}/{name}"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_wfst.round_trip(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.store_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)
    return token_files.read(manifest, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    rows = toxicity.score(docs, model)
    return rows.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages")
    )


def op4_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann_forest.search(rows, rows.filter("vec_id % 100 = 0"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    runs = warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(warc.index(runs, folder), columns="digest").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixture(table(spark, sf_dir, "documents"), max_repeats=4.0)
    return rows.withColumnRenamed("key", "doc_id")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs, keep_text=False)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = quality.score(docs, quality.fit(quality.labelled_sample(docs, table(spark, sf_dir, "labels"))))
    return rows.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_files": op2_token_files,
    "op3_toxicity": op3_toxicity,
    "op4_ann_forest": op4_ann_forest,
    "op5_warc": op5_warc,
    "op6_mixing": op6_mixing,
    "op7_repeats": op7_repeats,
    "op8_token_counts": op8_token_counts,
    "op9_simhash": op9_simhash,
    "op10_nn_descent": op10_nn_descent,
    "op11_alignment": op11_alignment,
    "op12_quality": op12_quality,
    "op13_merkle": op13_merkle,
}
CHECKS: dict[str, str] = {
    "op5_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    f AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
          CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
}
