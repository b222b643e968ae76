"""Corpus pipeline: five stages from raw documents to a mixed training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``. Null and empty texts pass every stage: they are
not toxic beyond the model's bias, link with nothing, hold no repeats and no test items, and mix with size 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import common, decontamination, mixing, ngram_join, suffix_dedup, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Shortest repeated passage, in bytes, that the corpus keeps only once: about 40 words.
PASSAGE_BYTES = 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5; it is fitted on the labelled documents (bounded sample)."""
    labels = common.table(spark, sf_dir, "labels").where(common.crc_mod("doc_id", 5) != 0)
    scored = toxicity.score_toxicity(docs.select(*COLUMNS), toxicity.fit(docs, labels))
    return scored.where(F.col("toxicity") < 0.5).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs.select(*COLUMNS), 5, 4, 5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document, or an earlier place, holds already."""
    found = suffix_dedup.find_repeats(docs.select(*COLUMNS), PASSAGE_BYTES, keep_first=True, whole_chars=True)
    text = F.when(F.size("spans") > 0, F.decode("kept", "UTF-8")).otherwise(F.col("text"))
    n_chars = F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item of the benchmark is found."""
    found = decontamination.find_leaks(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once per copy (``copy`` counts from 1), with their size and their source's target."""
    every = [F.col(c) for c in COLUMNS] + [F.col(c).isNull() for c in COLUMNS]
    rows = docs.select(*COLUMNS).withColumns({"_k": F.xxhash64(*every), "_l": F.xxhash64(*reversed(every))})
    mixed = mixing.mix(rows.select("doc_id", "text", "source", "_k", "_l"))
    # only rows equal in every column share a key
    taken = mixed.groupBy("_k", "_l").agg(F.sum("copies").alias("copies"), F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"))
    out = rows.dropDuplicates(["_k", "_l"]).join(taken.where("copies > 0"), ["_k", "_l"])
    return out.select(*COLUMNS, "size", "source_size", "target", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Trained models and set similarity are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again."""
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = out
    return docs
