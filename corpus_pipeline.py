"""A corpus from raw documents to packed sequences, stage by stage.

Every stage works on all rows that the one before it kept.  All but the last
return the columns of ``documents``, those that a table has besides too, whatever
their names.

Defined results, besides what each operator's module says: rows without doc_id are
rows like others; a null or empty text is judged by its metadata, is no copy of
anything, holds no item, and is packed as the end id alone if it is kept; rows that
are equal in doc_id and text are one document, of which one stays; texts are never
cut short, only repeated passages go, and a document whose whole text goes stays
as an empty one; ties go to the smaller doc_id; an empty table of documents gives an
empty result, without labels nothing is rejected, without a benchmark nothing is
contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termweave.llm import decontaminate, linededup, neardup, packing, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return neardup.deduplicated(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; n_chars follows."""
    return linededup.without_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The models of the stages can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written before the next; what is read no more is deleted."""
    from termweave.llm.shared import dropped, stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stored(stage(spark, docs, sf_dir), name)
        dropped(docs)
        docs = out
    return docs
