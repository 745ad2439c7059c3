"""The digest queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from permaway.llm import ann, decontam, htmltext, langid, licenses, neardup, packing, pii, sstable, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.digest(docs, langid.train(docs))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(_table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.digest(_table(spark, sf_dir, "pages"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.digest(_table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.digest(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": op1_licenses,
        "op2_language": op2_language,
        "op3_decontamination": op3_decontamination,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_html": op5_html,
        "op6_neighbours": op6_neighbours,
        "op7_toxicity": op7_toxicity,
        "op8_packing": op8_packing,
        "op9_sstable": op9_sstable,
        "op10_pii": op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": decontam.ORACLE_SQL, "op4_near_duplicates": neardup.ORACLE_SQL, "op5_html": htmltext.ORACLE_SQL}
