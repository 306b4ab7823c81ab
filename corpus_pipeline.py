"""Corpus pipeline: toxicity, near-duplicates, decontamination, mixing, token-id files.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of documents, whatever their names, and run() deletes a stage's table once the next one is
written, with all tables that its operators wrote.

* toxicity - documents the string-kernel machine rejects (score >= 0.5) go;
* near_dedup - of each group of near-duplicates the document with the least doc_id stays;
* decontamination - documents that hold a window of the benchmark go;
* mixing - each document stays as often as the mix takes it (copies 0 to 3), copies as rows of their own;
* token_ids - the mix is written as token-id files and read back: doc_id, start, n_tokens, ids_crc32.

Cases: null and empty texts are neither toxic, duplicates nor contaminated, and stay out of the mix (their size is 0), as
does a document without words; very long texts are read whole; ties go to the smaller doc_id; rows that repeat a doc_id
and text are rows of their own in every stage but mixing, which deals their copies out among them; rows without doc_id
are kept as others are; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideglass.llm import binary, decontaminate, mixing, near_dedup, toxicity
from tideglass.llm.queries import tokenizer_path
from tideglass.llm.shared import Stage, drop, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_ids_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return binary.round_trip(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_ids_stage),
]

#: The classifier, the rounding and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with Stage(spark) as tables:
            docs = tables.outlive(stage(spark, docs, sf_dir), name)
        if done is not None:
            drop(done)
        done = docs
    # the last stage has written its files before it returns
    out = STAGES[-1][1](spark, docs, sf_dir)
    drop(done)
    return out
