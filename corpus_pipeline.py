"""The corpus pipeline: five stages over ``documents``, each one written as Parquet and read back
before the next, so that a lost executor never repeats an earlier stage.

1. quality: documents scored below the quality threshold go;
2. near_duplicates: one document of each SimHash group stays;
3. repeated_strings: bytes of repeated 400-byte strings are cut out of the texts;
4. decontamination: documents contaminated with benchmark passages go;
5. packing: what is left is packed into sequences of at most 2048 tokens.

Stages 1 to 4 return the columns of ``documents`` (``n_chars``, where there is one, follows the
cut text). Null and empty texts are documents like any other.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.llm import decontaminate, packing, quality, simhash, suffixes
from carelake.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality.held_out)
    return quality.score(docs, model, "__llm_quality").where("__llm_quality >= 0.7").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_group(docs, shingle=3, max_bits=2).select(*docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffixes.cut_texts(docs, length=400)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality", good_quality), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings),
          ("decontamination", decontamination), ("packing", best_fit_packing)]

#: The first stage is a trained network, which SQL cannot express; tests/llm holds the pipeline
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
