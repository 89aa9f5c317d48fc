"""Aggregates over hits, sequences and depths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainspark.columns import q


def sample_summary(hits: DataFrame) -> DataFrame:
    """Per sample: distinct primary genes of each element type and drug classes, point mutations, gene variants and
    heteroresistant sites (these also of rows that aren't primary)."""
    primary, amr = F.col("primary"), F.col("element_type") == "AMR"
    kind = lambda t: F.count_distinct(F.when(primary & (F.col("element_type") == t), F.col("gene")))
    return hits.where("sample IS NOT NULL").groupBy("sample").agg(
        *[kind(t).alias(f"n_{t.lower()}_genes") for t in ("AMR", "VIRULENCE", "STRESS", "PLASMID")],
        F.count_distinct(F.when(primary & amr & (F.col("drug_class") != ""), F.col("drug_class"))).alias("n_classes"),
        F.count_if(primary & amr & (F.col("element_subtype") == "POINT") & (F.col("method") != "VARIANTR")).alias("n_point"),
        F.count_if(F.col("method").isin("VARIANTR", "ALLELER")).alias("n_variants"),
        F.count_if(amr & (F.col("method") == "POINTR") & F.contains("note", F.lit("HETERORESISTANT"))).alias("n_hetero"),
    )


def length_stats(df: DataFrame, keys: Sequence[str], length: str, shares: Sequence[int] = (50, 90)) -> DataFrame:
    """Per key: ``n``, ``total``, ``largest`` and ``nXX``: the length at which the longest sequences together first
    reach that share of the total.

    Lengths are counted first, so what is ordered is at most one row for each distinct length of a key.
    """
    counts = df.where(F.col(q(length)) > 0).groupBy(*[q(k) for k in keys], q(length)).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*[q(k) for k in keys])
    run = F.sum(F.col(q(length)) * F.col("_c")).over(w.orderBy(F.desc(q(length))).rowsBetween(Window.unboundedPreceding, 0))
    marked = counts.withColumn("_run", run).withColumn("_all", F.sum(F.col(q(length)) * F.col("_c")).over(w))
    return marked.groupBy(*[q(k) for k in keys]).agg(
        F.sum("_c").alias("n"), F.first("_all").alias("total"), F.max(q(length)).alias("largest"),
        *[F.max(F.when(F.col("_run") * 100 >= F.col("_all") * s, F.col(q(length)))).alias(f"n{s}") for s in shares],
    )


def weighted_share(part: Column, whole: Column) -> Column:
    """Sum of parts over sum of wholes, in percent; null if the wholes sum to 0. Negative parts count as 0."""
    return F.when(F.sum(whole) > 0, 100.0 * F.sum(F.greatest(F.lit(0), part)) / F.sum(whole))


def breadth_and_depth(depth: Column, length: Column | None = None) -> list[Column]:
    """Aggregates ``breadth_pct`` (positions covered at least once) and ``mean_depth`` over covered positions."""
    n = F.count(F.lit(1)) if length is None else length
    return [(100.0 * F.count_if(depth >= 1) / n).alias("breadth_pct"), F.avg(F.when(depth >= 1, depth)).alias("mean_depth")]


def family_collapse(df: DataFrame, keys: Sequence[str], family: Column, gene: str, best: Column, depth: str, *, names: int = 4) -> DataFrame:
    """One row per key and family: the ``gene`` that is greatest by ``best`` (a struct), the summed ``depth``, the number
    of genes and the first ``names`` of them in order."""
    listed = F.array_sort(F.collect_set(q(gene)))
    return df.groupBy(*[q(k) for k in keys], family.alias("family")).agg(
        F.max_by(q(gene), best).alias("gene"), F.sum(q(depth)).alias("depth"), F.count_distinct(q(gene)).alias("n_genes"), F.array_join(F.slice(listed, 1, names), ", ").alias("names")
    )


def concordance(a: DataFrame, b: DataFrame, group: Sequence[str], item: str) -> DataFrame:
    """Per group how two sets of items agree: ``shared``, ``only_a``, ``only_b`` and ``jaccard`` (null keys are left out)."""
    keys = [*group, item]
    x = a.select(*[q(k) for k in keys]).distinct().withColumn("_a", F.lit(1))
    y = b.select(*[q(k) for k in keys]).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, keys, "full_outer")
    n = both.groupBy(*[q(k) for k in group]).agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))
    return n.withColumn("jaccard", F.col("shared") / (F.col("shared") + F.col("only_a") + F.col("only_b")))
