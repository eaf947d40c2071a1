"""A training-data pipeline over ``documents``: each stage reads what the one before it kept.

Stages, in order: toxic documents go; one document of each group of near duplicates stays (5-word
shingles, Jaccard 0.8); documents that hold a benchmark item go; sources, languages and topics are
sampled towards target weights; what is left is packed into rows of token ids. All but the last
return the columns of ``documents``, and any others that the documents have, as they came.

Null and empty texts are clean, have no near duplicates and hold no item; they weigh one token and pack as an
end id. A row with a null doc_id is never a duplicate or a leak of another. Of rows with one doc_id all stay or
all go as duplicates and leaks, and in the draw. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import decontaminate, mixing, ngram_join, packing, toxicity
from strandline.llm._spark import Scratch, bounded_batches, table, tidy_driver


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel model scores below 0.5 stay."""
    bounded_batches(spark)
    tidy_driver(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest doc_id."""
    tidy_driver(spark)
    return ngram_join.one_of_each(docs, k=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay."""
    tidy_driver(spark)
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by calibrated probabilities of source, language and topic; it has the target marginals itself, without weights."""
    tidy_driver(spark)
    return mixing.mix(docs, exact=True).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of token ids with segment lengths and position resets."""
    bounded_batches(spark)
    tidy_driver(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("mixing_weights", mixture),
    ("token_packing", packed),
]

#: Models, similarity joins and packing are not expressible in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written to the shared folder and read again, and then its input is dropped."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.put(docs)
            scratch.drop(before)
    return docs
