"""Problem 6: test items in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainspark.llm.leaks import find_leaks
from strainspark.queries.tables import table


#: Characters that may be edited in each twelve words of a passage.
EDITS = 2


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), max_edits=EDITS)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Passages that are whole equal words: found with an edit to spare, then checked word by word."""
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), max_edits=1).where("n_exact > 0").select("doc_id", "item_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, into how many documents, and the most words in one."""
    return p6_leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_words").alias("most_words"))


QUERIES = {"p6_found": p6_found, "p6_leaks": p6_leaks, "p6_items": p6_items}
SQL = {}
