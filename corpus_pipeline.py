"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input.

Null and empty texts go through all stages but the last, which takes no document without words. Null ids and ids of
any type that orders are kept. Rows repeated with id and text are judged alike: all go or stay together, but for the
near-duplicate stage and the mix, which keep one of them. Further columns stay as they are. An empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.llm.common import shared_dir, table
from lemmaflow.llm.decontaminate import drop_contaminated
from lemmaflow.llm.mixing import apply_mix
from lemmaflow.llm.secrets import redact_secrets
from lemmaflow.llm.simhash import drop_near_duplicates
from lemmaflow.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of op9 doesn't reject (score under 0.7)."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of op5, the one with the smallest id."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark: a passage in a long text is a leak as well as one alone."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets of op4 blotted out of the text and ``n_chars``, if there, counted anew where they were."""
    clean = redact_secrets(docs)
    if "n_chars" not in clean.columns:
        return clean
    kind = clean.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.col("text").contains("[SECRET]"), F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of op10: the documents taken, whole, each with the number of its ``copies``; those that give no word are out."""
    return apply_mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact),
    ("mixing", mix),
]

#: A trained model, XXH64 fingerprints and random rounding are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{base}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
