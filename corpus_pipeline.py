"""Five stages from documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.llm.common import carried, drop, scratch
from bandwright.llm.decontamination import scan
from bandwright.llm.jaccard_join import link_documents
from bandwright.llm.language_id import UNKNOWN, labelled
from bandwright.llm.line_dedup import dedup_lines
from bandwright.llm.packing import pack

#: A text's mean word posterior must lie by this share of the way from chance (one in the number of languages) to certainty.
LEAST_MARGIN = 0.15


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a language; null or empty texts, those without a letter, or that no language explains, go.

    With one learned language every text with a letter stays.  Nulls in other columns, repeated rows and names of
    columns make no difference; an empty table gives none.
    """
    found, languages = labelled(docs)
    least = (1 + LEAST_MARGIN * (len(languages) - 1)) / len(languages) if languages else 0.0
    found = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out every line that is like one kept before; documents left without any line go.

    Documents with a null doc_id or text stay as they are; an empty table gives none.
    """
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document (the smallest doc_id) of each class of linked ones: five words, Jaccard 0.8.

    Documents with a null doc_id, or without words, link with nothing and stay; rows with one doc_id are one document.
    """
    classes = link_documents(docs, n=5, num=80, den=100)
    gone = classes.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    out = carried(docs).join(gone, F.col(f"c{docs.columns.index('doc_id')}").cast("long") == F.col("gone"), "left_anti")
    return out.toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which ten words in a row of a benchmark item (all, of a shorter item) occur.

    Null and empty texts stay; so do all documents where the benchmark is empty.
    """
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10, with_spans=False)
    return found.where("not contaminated").select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, without the ids themselves; null and empty texts are one end id."""
    from public_tokenizers import path

    return pack(docs, path("byte_bpe_50k.json"), "byte", end_id=0, length=1024, with_ids=False)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Several stages (labelling, fuzzy lines, packing) are beyond SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again, and deleted after the next stage's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop(spark, before)
        before = path
    return docs
