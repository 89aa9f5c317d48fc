"""Queries on intervals and wide tables over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainspark.operators.periods import periods_and_gaps, stretches
from strainspark.operators.wide import attributes, cells, column_names, narrow, widen
from strainspark.queries.tables import table


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """axis, key_a, key_b, lo, hi of problem 3."""
    h = table(spark, d, "hits").where("sample IS NOT NULL AND sequence <> '' AND start >= 1 AND end >= 1")
    contig = h.select(F.lit("contig").alias("axis"), F.col("sample").alias("key_a"), F.col("sequence").alias("key_b"), F.col("start").alias("lo"), F.col("end").alias("hi"))
    m = table(spark, d, "merged_hits").select(F.lit("reference").alias("axis"), F.col("qseqid").alias("key_a"), F.col("sseqid").alias("key_b"), F.inline("subject_intervals"))
    return contig.unionByName(m)


KEYS = ["axis", "key_a", "key_b"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(intervals(spark, d), KEYS, "lo", "hi", only_merged=True)


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Stretches and covered positions of each contig and reference."""
    s = stretches(intervals(spark, d), KEYS, "lo", "hi")
    return s.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_stretches"), F.sum(F.col("hi") - F.col("lo") + 1).alias("covered"), F.sum(F.col("next_lo") - F.col("hi") - 1).alias("uncovered"))


def genes(spark: SparkSession, d: str) -> DataFrame:
    """sample, gene, identity_pct of problem 5."""
    h = table(spark, d, "hits").where("primary AND sample IS NOT NULL AND identity_pct IS NOT NULL").select("sample", F.trim("gene").alias("gene"), "identity_pct")
    return h.where("gene <> ''")


def _wide(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, str]]:
    """One row per sample with a numeric column for each gene, and the genes' columns."""
    rows = genes(spark, d)
    names = column_names(attributes(rows, "gene"), "sample")
    return widen(rows, "sample", "gene", "identity_pct", keys=list(names), names=names), names


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The cells of the wide table whose rows disagree."""
    wide, names = _wide(spark, d)
    return narrow(wide, "sample", names).where("disagree").select("sample", F.col("attribute").alias("gene"))


def p5_wide(spark: SparkSession, d: str) -> DataFrame:
    """The whole wide table: a numeric column for each gene, under the gene's own name."""
    return _wide(spark, d)[0]


def p5_wide_cells(spark: SparkSession, d: str) -> DataFrame:
    """The wide table's columns read back as rows, with what could not be cast."""
    wide, names = _wide(spark, d)
    back = narrow(wide, "sample", names)
    failed = wide.select("sample", F.explode("cast_failures").alias("attribute", "text"))
    rows = back.select("sample", F.col("attribute").alias("gene"), F.col("value").alias("identity_pct"), "disagree", F.lit(False).alias("failed"))
    return rows.unionByName(failed.select("sample", F.col("attribute").alias("gene"), F.lit(None).cast("double").alias("identity_pct"), F.lit(False).alias("disagree"), F.lit(True).alias("failed")))


def p5_cells(spark: SparkSession, d: str) -> DataFrame:
    c = cells(genes(spark, d), "sample", "gene", "identity_pct")
    return c.select(F.col("entity").alias("sample"), F.col("attribute").alias("gene"), F.col("value").cast("double").alias("identity_pct"), "disagree")


QUERIES = {"p3_found": p3_found, "p3_coverage": p3_coverage, "p5_found": p5_found, "p5_wide": p5_wide, "p5_wide_cells": p5_wide_cells, "p5_cells": p5_cells}

_INTERVALS = """
WITH m AS (SELECT qseqid, sseqid, unnest(subject_intervals) AS e FROM merged_hits),
iv0 AS (
  SELECT 'contig' AS axis, sample AS key_a, sequence AS key_b, "start"::BIGINT AS x, "end"::BIGINT AS y FROM hits
  WHERE sample IS NOT NULL AND sequence <> '' AND "start" >= 1 AND "end" >= 1
  UNION ALL SELECT 'reference', qseqid, sseqid, e.lo::BIGINT, e.hi::BIGINT FROM m WHERE e.lo IS NOT NULL AND e.hi IS NOT NULL),
iv AS (SELECT DISTINCT axis, key_a, key_b, least(x, y) AS lo, greatest(x, y) AS hi FROM iv0),
marked AS (SELECT *, lo > max(hi) OVER (PARTITION BY axis, key_a, key_b ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS later FROM iv),
numbered AS (SELECT *, count(*) FILTER (later) OVER (PARTITION BY axis, key_a, key_b ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM marked),
s0 AS (SELECT axis, key_a, key_b, g, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM numbered GROUP BY ALL),
s AS (SELECT *, lead(lo) OVER (PARTITION BY axis, key_a, key_b ORDER BY lo) AS next_lo FROM s0)
"""
_GENES = """WITH g0 AS (SELECT sample, trim(gene) AS gene, identity_pct FROM hits WHERE "primary" AND sample IS NOT NULL AND identity_pct IS NOT NULL AND trim(gene) <> ''),
c AS (SELECT sample, gene, max(identity_pct) AS identity_pct, min(identity_pct) < max(identity_pct) AS disagree FROM g0 GROUP BY ALL)
"""
SQL = {
    "p3_found": _INTERVALS
    + """SELECT axis, key_a, key_b, 'covered' AS kind, lo, hi FROM s WHERE n > 1
UNION ALL SELECT axis, key_a, key_b, 'gap', hi + 1, next_lo - 1 FROM s WHERE next_lo IS NOT NULL""",
    "p3_coverage": _INTERVALS + "SELECT axis, key_a, key_b, count(*) AS n_stretches, sum(hi - lo + 1)::BIGINT AS covered, sum(next_lo - hi - 1)::BIGINT AS uncovered FROM s GROUP BY ALL",
    "p5_found": _GENES + "SELECT sample, gene FROM c WHERE disagree",
    "p5_cells": _GENES + "SELECT sample, gene, identity_pct, disagree FROM c",
    # A view can't pivot on names that the data give, so the wide table is compared through its columns read back.
    "p5_wide_cells": _GENES + "SELECT sample, gene, identity_pct, disagree, false AS failed FROM c",
}
