"""Corpus preparation as a chain of training-data operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage before it kept; all but the
last return the columns of ``documents``. A null text counts as empty; such rows, empty tables, repeated rows
and further columns pass through every stage as its operator says, and verdicts go to rows, told by their
doc_id and their text's key, so that a null or repeated doc_id takes nothing else with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, filters, jaccard, packing, substring, toxicity
from gleaner.llm.common import discard, scratch, settle

#: No SQL states this: a classifier and a tokenizer take part. tests/llm holds it against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity classifier does not reject."""
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(F.col("predicted") == 0).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least doc_id."""
    return filters.one_of_each(docs, jaccard.near_copies(docs))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 or more words that stand elsewhere too.

    A text that loses words is rebuilt from those it keeps (none, if all of it stands elsewhere), others
    stay as they were; n_chars follows. Every document stays.
    """
    out = substring.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keys=True)
    return filters.without(docs, found.where("contaminated").select("doc_id", "h1", "h2"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("substring_dedup", remove_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to the written result of the one before.

    A stage's table and all that it wrote on the way are removed once the next one is written; only the last
    result stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with scratch(spark):
            done = settle(stage(spark, docs, sf_dir), outlast=True)
        discard(docs)
        docs = done
    return docs
