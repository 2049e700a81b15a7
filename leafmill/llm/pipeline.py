"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame, each on all of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontaminate as seeds
from leafmill.llm import near_copies, pieces, suffix_dedup, toxicity
from leafmill.storage import bounded_batches

#: Near copies: words of a shingle, and the least similarity of two sets, in hundredths.
SHINGLE_WORDS, SIMILARITY = 5, 80
#: Repeated passages: words.
REPEAT_WORDS = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that score as toxic; the model is fitted on labels of these documents.

    Every row is judged by its own text, also rows without an id, of one id, or that repeat; null and empty texts
    are not toxic by themselves (they score the prior); an empty table gives an empty one; all columns stay.
    """
    bounded_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model, name="own score").filter(F.col("own score") < toxicity.THRESHOLD).drop("own score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id (null last; of several any one).

    Texts without words (null, empty, white space) are copies of each other. An empty table gives an empty one; all columns stay.
    """
    bounded_batches(spark)
    return near_copies.without_near_copies(docs, shingle_words=SHINGLE_WORDS, percent=SIMILARITY)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of fifty words or more that an earlier document (or place) has.

    Rows are told apart by id and text, so rows of one id keep their own texts; repeated rows are one text, rows
    without an id come last. Null texts stay null; n_chars follows the text; an empty table gives an empty one.
    """
    bounded_batches(spark)
    cut = suffix_dedup.remove_repeats(docs, unit="words", threshold=REPEAT_WORDS, keep_digest=True)
    changed = cut.filter("n_removed > 0").select(F.struct("id", "digest").alias("cut of"), F.col("kept").cast("string").alias("kept text")).dropDuplicates(["cut of"])
    own = F.struct(F.col("doc_id").cast("long").alias("id"), suffix_dedup.text_digest(F.col("text")).alias("digest"))
    rows = docs.join(changed, own == F.col("cut of"), "left")
    new = F.col("kept text").isNotNull()
    text, size = F.coalesce("kept text", "text"), F.when(new, F.length("kept text").cast("long")).otherwise(F.col("n_chars"))
    return rows.select(*(text.alias(c) if c == "text" else size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold part of a benchmark item.

    A row is known by its text's digest, so ids may be null or shared, and all rows of a text go together. Null
    and empty texts hold nothing; an empty table gives an empty one; all columns stay.
    """
    own = suffix_dedup.text_digest(F.col("text"))
    found = seeds.overlaps(docs.select(own.alias("own digest"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="own digest")
    return docs.join(found.select(F.col("id").alias("own digest")).distinct(), own == F.col("own digest"), "left_anti")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the round trip through decoding verified; null and empty texts have none."""
    bounded_batches(spark)
    coded = pieces.encode(docs, pieces.load())
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", "token_ids", "round_trip")
