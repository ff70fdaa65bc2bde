"""A corpus pipeline: each stage works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns documents, the last one with a rate for each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import decontam, mixing, quality, secrets, simhash
from quernstone.llm.common import bounded, drop_folder, ensure_checkpoint_dir, fresh, importable, table
from quernstone.llm.queries import TARGETS


# Each stage takes any columns beside those of documents and gives them back, whatever their names, and no rows for an
# empty table. A null text is an empty one.


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject; all if nothing is labelled.

    Null values are values of their own; rows with a null id are judged too. Repeated rows share their fate.
    """
    bounded(spark)
    return quality.reject(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Null and empty texts are one group. Of repeated rows one stays; rows with a null id all stay.
    """
    importable(spark)
    bounded(spark)
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    Rows with a null id stay; repeated rows share their fate; an empty benchmark leaks nothing.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars follows the text.

    A null text stays null; repeated rows and those with a null id are cleaned alike.
    """
    spans, found = fresh(docs.columns, "spans", "found")
    scanned = secrets.scan(docs, into=spans).withColumn(found, F.size(spans) > 0)
    cleaned = secrets.redact(scanned, spans=spans)
    n_chars = F.when(F.col(found), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each with its tokens, likeliest domain, membership and rate; columns of these names are replaced.

    Null and empty texts have no tokens and a rate like others; repeated rows have the same rate.
    """
    importable(spark)
    bounded(spark)
    return mixing.mixed(docs, mixing.vetted(docs, table(spark, sf_dir, "labels")), TARGETS)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("mixing to target weights", mixing_stage),
]

#: SQL expresses neither the classifiers nor the fitted rates; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again, the one before it goes."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            drop_folder(spark, f"{folder}/{k - 1}.parquet")
    return docs
