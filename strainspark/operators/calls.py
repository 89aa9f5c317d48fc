"""Calls from merged evidence: whole references by covered positions, closest alleles, variants of a marker, read sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainspark.columns import q
from strainspark.operators.periods import stretches


def reference_coverage(df: DataFrame, keys: Sequence[str], reference: str, lo: str, hi: str, length: str) -> DataFrame:
    """``keys``, ``reference``, ``covered`` and ``coverage_pct``: how much of each reference the intervals cover together."""
    s = stretches(df, [*keys, reference], lo, hi)
    n = df.where(F.col(q(length)) > 0).groupBy(q(reference)).agg(F.max(q(length)).alias("_n"))
    c = s.groupBy(*[q(k) for k in keys], q(reference)).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("covered"))
    return c.join(n, reference).select(*[q(k) for k in keys], q(reference), "covered", (100.0 * F.col("covered") / F.col("_n")).alias("coverage_pct"))


def best_reference(coverage: DataFrame, keys: Sequence[str], reference: str, *, least: float = 60.0) -> DataFrame:
    """The reference that is covered most (of equals the last by name), or 'none' below ``least`` percent."""
    top = coverage.groupBy(*[q(k) for k in keys]).agg(F.max(F.struct("coverage_pct", q(reference))).alias("m"))
    call = F.when(F.col("m.coverage_pct") >= least, F.col(f"m.{q(reference)}")).otherwise("none")
    return top.select(*[q(k) for k in keys], call.alias("call"), F.col("m.coverage_pct").alias("coverage_pct"))


def closest_alleles(consensus: DataFrame, alleles: DataFrame, keys: Sequence[str], group: str, *, seq: str = "seq", allele: str = "allele", allele_seq: str = "seq") -> DataFrame:
    """For each consensus the allele of the same group and length with the most equal positions (of equals the lowest).

    ``keys``, ``group``, ``allele``, ``n_same``, ``length``. N and other letters of the consensus are never equal.
    """
    c = consensus.select(*[q(k) for k in keys], q(group), F.upper(q(seq)).alias("_c")).withColumn("_n", F.length("_c"))
    a = alleles.select(F.col(q(group)).alias("_g"), F.col(q(allele)).alias("_allele"), F.upper(q(allele_seq)).alias("_a")).withColumn("_m", F.length("_a"))
    met = c.join(a, (F.col(q(group)) == F.col("_g")) & (F.col("_n") == F.col("_m")))
    same = F.size(F.filter(F.zip_with(F.split("_c", ""), F.split("_a", ""), lambda x, y: (x == y) & x.isin("A", "C", "G", "T")), lambda x: x))
    return met.withColumn("n_same", same).groupBy(*[q(k) for k in keys], q(group)).agg(F.max_by(F.struct(F.col("_allele").alias("allele"), "n_same", F.col("_n").alias("length")), F.struct("n_same", _low(F.col("_allele")))).alias("m")).select(*[q(k) for k in keys], q(group), "m.*")


def _low(c: Column) -> Column:
    """A key that is greatest for the lowest string: its bytes, each turned over, behind an end mark."""
    return F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def marker_variants(df: DataFrame, keys: Sequence[str], name: str, stem: Column, order: Sequence[Column]) -> DataFrame:
    """Rows whose stem several names of the key share are cut down to the best in ``order``; others stay."""
    w = Window.partitionBy(*[q(k) for k in keys], "_stem")
    marked = df.withColumn("_stem", stem).withColumn("_n", F.when(F.min(q(name)).over(w) < F.max(q(name)).over(w), 2).otherwise(1)).withColumn("_r", F.row_number().over(w.orderBy(*order)))
    return marked.where((F.col("_n") == 1) | (F.col("_r") == 1)).drop("_stem", "_n", "_r")


def read_stats(reads: DataFrame, keys: Sequence[str], seq: str = "seq", quality: str = "quality") -> DataFrame:
    """Per key: reads, mean length and mean base quality (offset 33)."""
    from strainspark.functions.sequences import phred_sum

    n = F.sum(F.length(q(seq)))
    return reads.groupBy(*[q(k) for k in keys]).agg(F.count(F.lit(1)).alias("n_reads"), F.avg(F.length(q(seq))).alias("mean_length"), F.when(n > 0, F.sum(phred_sum(F.col(q(quality)))) / n).alias("mean_quality"))


def called_genes(df: DataFrame, keys: Sequence[str], breadth: str, identity: str, depth: str, *, min_breadth: float = 60.0, min_identity: float = 80.0, min_depth: float = 5.0, family: Column, gene: str = "gene") -> DataFrame:
    """Genes called from reads: rows over breadth and identity, collapsed by family (the best by breadth, identity, depth;
    depths summed), and then over the least depth."""
    from strainspark.operators.summaries import family_collapse

    ok = df.where((F.col(q(breadth)) >= min_breadth) & (F.col(q(identity)) >= min_identity))
    return family_collapse(ok, keys, family, gene, F.struct(q(breadth), q(identity), q(depth), q(gene)), depth).where(F.col("depth") >= min_depth)


def disrupted(hsps: DataFrame, rules: DataFrame, keys: Sequence[str], gene: str = "gene", *, organism: str | None = None, low: float = 20.0, high: float = 90.0) -> DataFrame:
    """Genes of ``rules`` of which a key's longest single HSP covers at least ``low`` but less than ``high`` percent.

    ``rules`` holds ``gene``, ``min_identity`` and ``organisms`` (an array; null allows any). HSPs below the gene's identity
    don't count; HSPs are not merged. With ``organism`` (a column of ``hsps``) a rule applies only to its
    organisms. ``keys``, ``gene``, ``coverage_pct``, ``pident``.
    """
    r = rules.select(F.col("gene").alias("_g"), "min_identity", "organisms")
    span = F.abs(F.col("send") - F.col("sstart")) + 1
    met = hsps.where(F.col("slen") > 0).join(r, (F.col(q(gene)) == F.col("_g")) & (F.col("pident") >= F.col("min_identity")))
    if organism:
        met = met.where(F.col("organisms").isNull() | F.array_contains("organisms", F.col(q(organism))))
    best = met.groupBy(*[q(k) for k in keys], q(gene)).agg(F.max(F.struct((100.0 * span / F.col("slen")).alias("coverage_pct"), "pident")).alias("m"))
    return best.select(*[q(k) for k in keys], q(gene), "m.*").where(F.col("coverage_pct").between(low, high) & (F.col("coverage_pct") < high))


def divergent(hits: DataFrame, cutoffs: DataFrame, key: str, identity: str = "identity_pct") -> DataFrame:
    """Hits whose identity lies below the cutoff of their ``key`` (``cutoffs``: the key and ``cutoff``); others have none."""
    c = cutoffs.where("cutoff IS NOT NULL").groupBy(q(key)).agg(F.min("cutoff").alias("_cutoff"))
    return hits.join(c, key).where(F.col(q(identity)) < F.col("_cutoff")).drop("_cutoff").select(*[q(x) for x in hits.columns])
