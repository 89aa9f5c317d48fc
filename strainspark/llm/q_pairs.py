"""Problem 1: genes reported together in one sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainspark.llm.pairs import PairTable
from strainspark.queries.tables import table
from strainspark.session import scratch


def baskets(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hits").where("primary AND sample IS NOT NULL").select("sample", F.trim("gene").alias("gene"), "loaded_at")
    return h.where("gene <> ''")


def pair_table(spark: SparkSession, d: str) -> PairTable:
    """All baskets in two batches: what was loaded in the first nine tenths of the time, then the rest,
    which also adds genes to samples that are there."""
    h = baskets(spark, d)
    first, last = table(spark, d, "hits").agg(F.min("loaded_at"), F.max("loaded_at")).first()
    t = PairTable(spark, scratch(spark, "pairs"))
    if first is None:
        t.apply(h, "sample", "gene")
        return t
    cut = F.lit(first + (last - first) * 0.9)
    t.apply(h.where(F.col("loaded_at") <= cut), "sample", "gene")
    t.apply(h.where((F.col("loaded_at") > cut) | F.col("loaded_at").isNull()), "sample", "gene")
    return t


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    t = pair_table(spark, d)
    least = max(5, -(-t.total // 100))
    s = t.scores(min_count=least).where(F.col("n") * t.total >= 3 * F.col("n_a") * F.col("n_b"))
    return s.select(F.col("a").alias("gene_a"), F.col("b").alias("gene_b"))


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair with its count and lift."""
    s = pair_table(spark, d).scores()
    return s.select(F.col("a").alias("gene_a"), F.col("b").alias("gene_b"), F.col("n").alias("n_samples"), F.round("lift", 6).alias("lift"))


def p1_affected(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose score the last batch changed by more than the total."""
    s = pair_table(spark, d).affected()
    return s.select(F.col("a").alias("gene_a"), F.col("b").alias("gene_b"), F.col("n").alias("n_samples"), F.round("lift", 6).alias("lift"))


def p1_replaced(spark: SparkSession, d: str) -> DataFrame:
    """The pairs after samples that were called again are given anew: whole contents of every sample that has a hit in
    the last tenth of the time become what was loaded then, so pairs are counted down and samples shrink."""
    t = PairTable(spark, scratch(spark, "pairs"))
    h = baskets(spark, d)
    t.apply(h, "sample", "gene")
    first, last = table(spark, d, "hits").agg(F.min("loaded_at"), F.max("loaded_at")).first()
    if first is not None:
        t.apply(h.where(F.col("loaded_at") > F.lit(first + (last - first) * 0.9)), "sample", "gene", replace=True)
    s = t.scores()
    return s.select(F.col("a").alias("gene_a"), F.col("b").alias("gene_b"), F.col("n").alias("n_samples"), F.round("lift", 6).alias("lift"))


QUERIES = {"p1_replaced": p1_replaced, "p1_found": p1_found, "p1_pairs": p1_pairs, "p1_affected": p1_affected}

_P = """WITH b AS (SELECT DISTINCT sample, trim(gene) AS gene FROM hits WHERE "primary" AND sample IS NOT NULL AND trim(gene) <> ''),
t AS (SELECT count(DISTINCT sample) AS t FROM b), i AS (SELECT gene, count(*) AS n FROM b GROUP BY gene),
p AS (SELECT x.gene AS gene_a, y.gene AS gene_b, count(*) AS n FROM b x JOIN b y ON x.sample = y.sample AND x.gene < y.gene GROUP BY ALL),
s AS (SELECT p.gene_a, p.gene_b, p.n, i.n AS na, j.n AS nb, t FROM p JOIN i ON i.gene = p.gene_a JOIN i j ON j.gene = p.gene_b, t)
"""
_REPLACED = """WITH w AS (SELECT min(loaded_at) + (max(loaded_at) - min(loaded_at)) * 0.9 AS cut FROM hits),
h AS (SELECT sample, trim(gene) AS gene, coalesce(loaded_at > cut, false) AS late FROM hits, w WHERE "primary" AND sample IS NOT NULL AND trim(gene) <> ''),
again AS (SELECT DISTINCT sample FROM h WHERE late),
b AS (SELECT DISTINCT sample, gene FROM h WHERE late OR sample NOT IN (SELECT sample FROM again)),
"""
_LAST = """, w AS (SELECT min(loaded_at) + (max(loaded_at) - min(loaded_at)) * 0.9 AS cut FROM hits),
early AS (SELECT DISTINCT sample, trim(gene) AS gene FROM hits, w WHERE "primary" AND sample IS NOT NULL AND trim(gene) <> '' AND loaded_at <= cut),
added AS (SELECT * FROM b EXCEPT SELECT * FROM early), touched AS (SELECT DISTINCT gene FROM added)
"""
SQL = {
    "p1_replaced": _REPLACED + _P.split("\n", 1)[1] + "SELECT gene_a, gene_b, n AS n_samples, round(n::DOUBLE * t / (na::DOUBLE * nb), 6) AS lift FROM s",
    "p1_found": _P + "SELECT gene_a, gene_b FROM s WHERE n >= 5 AND 100 * n >= t AND n * t >= 3 * na * nb",
    "p1_pairs": _P + "SELECT gene_a, gene_b, n AS n_samples, round(n::DOUBLE * t / (na::DOUBLE * nb), 6) AS lift FROM s",
    "p1_affected": _P + _LAST + """SELECT gene_a, gene_b, n AS n_samples, round(n::DOUBLE * t / (na::DOUBLE * nb), 6) AS lift FROM s
WHERE gene_a IN (SELECT gene FROM touched) OR gene_b IN (SELECT gene FROM touched)""",
}
