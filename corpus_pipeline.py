"""A corpus cleaned and packed in five stages, each one an operator of synapta.llm over all that the stage before it kept.

1. toxicity: documents that the classifier judges toxic go.
2. near duplicates: one document of each SimHash group stays.
3. repeated passages: passages of 50 words that documents share are cut from all but the first.
4. decontamination: documents that hold a passage of the benchmark go.
5. packing: what is left is cut into windows of 2048 tokens with boundary records.

The first four return the columns they were given. ``run`` writes each stage's result and reads
it again, so a lost executor costs at most a stage; a stage's table is deleted once the next one is written.

Cases: rows with a null doc_id stay through all stages unless they are toxic or contaminated; null and empty
texts stay and are packed as an end-of-text token; rows that share a doc_id stay or go together as near duplicates,
and are judged each as toxic or contaminated; ties go to the smallest doc_id; very long texts are read whole; without labels nothing is toxic, with an
empty benchmark nothing is contaminated; an empty table gives no window; other columns are kept, whatever their
names, up to packing, which ignores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from synapta.llm import decontaminate, packing, simhash_dedup, suffix_dedup, toxicity
from synapta.llm._text import discard, stored_at


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.remove(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL has neither the classifier nor the tokens; tests compare ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored_at(stage(spark, docs, sf_dir), name)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
