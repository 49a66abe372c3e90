"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate, items_sha256

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, _table(spark, sf_dir, "benchmark"), n=10, with_spans=False, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", items_sha256("items").alias("items_sha256"), "contaminated")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), "byte", end_id=0, length=1024, with_ids=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep=["doc_id"])


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivatives, responses

    return derivatives(responses(_table(spark, sf_dir, "pages")))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    table = _table(spark, sf_dir, "embeddings")
    return top_k(table, F.col("vec_id") % 100 == 0).withColumnRenamed("id", "vec_id")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .common import scratch
    from .token_files import read_token_files, write_token_files

    where = scratch(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), where, path("word_bpe_49k.json"), "word", end_id=1)
    return read_token_files(spark, where, with_ids=False)


# fixed values: the rules (verdict, host, path) that the query is asked to apply
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_classes

    return line_classes(_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import link_documents

    return link_documents(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return dict(ORACLES)


__all__ = ["oracle_sql", "queries"]
