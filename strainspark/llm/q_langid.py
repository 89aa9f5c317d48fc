"""Problem 8: languages of the documents, and labels that are missing or wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strainspark.llm.langid import fit, label_code, languages_of, segments
from strainspark.queries.tables import table


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return segments(docs, fit(docs))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return languages_of(segments(docs, fit(docs), keep=["lang"]), keep=["lang"])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = p8_languages(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    code = label_code(F.col("lang"))
    case = code.isNull() | (F.col("n") > 1) | (code != F.col("language"))
    return found.where(case).select("doc_id", "language")


QUERIES = {"p8_found": p8_found, "p8_segments": p8_segments, "p8_languages": p8_languages}
SQL = {}
