"""Problem 4: products and classes of meta and the entries of the clean lists that they mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainspark.llm.canonical import canonicalise
from strainspark.queries.tables import table


def product_entries(spark: SparkSession, d: str) -> DataFrame:
    """Each product with what must be named: its family (first word) and its activity (the words after the class)."""
    products = table(spark, d, "product_list").select("product_id", "product", F.lower("product").alias("low"))
    classes = table(spark, d, "class_list").select(F.lower("class_name").alias("class"))
    words = products.select("product_id", F.posexplode(F.split("low", r"\s+")).alias("at", "class")).where("at > 0")
    after = words.join(classes, "class").groupBy("product_id").agg(F.min("at").alias("at"))
    parts = F.split("low", r"\s+")
    activity = F.array_join(F.slice(parts, F.coalesce("at", F.lit(0)) + 2, F.size(parts)), " ")
    named = F.transform(F.array(parts[0], activity), lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))
    return products.join(after, "product_id", "left").select(F.col("product_id").alias("entry_id"), F.col("product").alias("entry"), named.alias("required"))


def class_entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "class_list").select(F.col("class_id").alias("entry_id"), F.col("class_name").alias("entry"), F.array(F.lower("class_name")).alias("required"))


def products(spark: SparkSession, d: str) -> DataFrame:
    return canonicalise(_odd(spark, d, "product"), "product", product_entries(spark, d), required="required", threshold=0.2)


def classes(spark: SparkSession, d: str) -> DataFrame:
    return canonicalise(_odd(spark, d, "class"), "class", class_entries(spark, d), required="required", several=True, n=2, threshold=0.2)


def _odd(spark: SparkSession, d: str, field: str) -> DataFrame:
    """seqid and value where it is neither blank nor letter for letter an entry."""
    name = {"product": "product", "class": "class_name"}[field]
    entries = table(spark, d, f"{field}_list").select(F.col(name).alias("listed"))
    rows = table(spark, d, "meta").select("seqid", field).where(F.regexp_replace(field, r"[\s ]+", "") != "")
    return rows.join(entries, F.col(field) == F.col("listed"), "left_anti")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    def rows(field: str, found: DataFrame) -> DataFrame:
        both = _odd(spark, d, field).join(found, field)
        return both.select("seqid", F.lit(field).alias("field"), F.coalesce("entry_id", F.lit(0)).cast("bigint").alias("entry_id"))

    return rows("product", products(spark, d)).unionByName(rows("class", classes(spark, d))).distinct()


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct value with its entry and score; unmatched values have neither."""

    def named(field: str, found: DataFrame) -> DataFrame:
        return found.select(F.lit(field).alias("field"), F.col(field).alias("value"), "entry_id", F.round("score", 4).alias("score"))

    return named("product", products(spark, d)).unionByName(named("class", classes(spark, d)))


QUERIES = {"p4_found": p4_found, "p4_values": p4_values}
SQL = {}
