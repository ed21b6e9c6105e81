"""The corpus pipeline: toxicity, near-duplicates, repeated passages, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows
to the shared folder and reads them back for the next. All stages but the last return the columns
of ``documents``. No stage can be said in SQL as a whole, so ORACLE_SQL is None; tests/llm holds
each against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import mixing, repeats, sentencepiece_wfst, simhash, toxicity
from wayfold.llm.common import kept, table
from wayfold.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No source is read more often than this many times as often as the least repeated one.
MAX_REPEATS = 2.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; all others stay as they are."""
    model = toxicity.fit(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs.select(COLUMNS), model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return simhash.representatives(docs.select(COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that start earlier elsewhere go; a document left without words goes too.

    n_chars follows a changed text. Documents that had no words before stay.
    """
    cut = repeats.remove_repeats(docs.select(COLUMNS))
    left = cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", length).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once per copy in the mixture; every document has one copy at least."""
    docs = docs.select(COLUMNS)
    copies = mixing.mixture(docs.filter("doc_id IS NOT NULL"), max_repeats=MAX_REPEATS)
    # Rows that share a doc_id and source each take all copies of that pair's rows.
    times = copies.groupBy(F.col("key").alias("_key"), F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    alike = docs.groupBy(F.col("doc_id").alias("_doc"), F.col("source").alias("_from")).agg(F.count(F.lit(1)).alias("_rows"))
    times = times.join(alike, (F.col("_key") == F.col("_doc")) & F.col("_source").eqNullSafe(F.col("_from")))
    share = times.select("_key", "_source", F.greatest(F.ceil(F.col("_n") / F.col("_rows")), F.lit(1)).cast("int").alias("_times"))
    match = (docs["doc_id"] == share["_key"]) & docs["source"].eqNullSafe(share["_source"])
    joined = docs.join(share, match, "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.coalesce("_times", F.lit(1)))))
    return joined.select(COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding gives the text again."""
    return sentencepiece_wfst.round_trip(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mixture", mix_sources),
    ("tokens", encode_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), spark)
    return STAGES[-1][1](spark, docs, sf_dir)
