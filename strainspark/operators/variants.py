"""Variants from base counts: gates, lists of sites, and the rows that are reported."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainspark.columns import q
from strainspark.functions.stats import binomial_upper_tail


def alternate_bases(counts: DataFrame, reference: str, *, error: float = 0.002) -> DataFrame:
    """A row for each base that is seen beside the one of the ``reference`` column: ``counts`` (see base_counts) without its
    count columns, and ``alt``, ``alt_count``, ``fraction`` and ``p_value`` (of at least as many by error alone)."""
    bases = F.array(*[F.struct(F.lit(b).alias("alt"), F.col(f"n_{b.lower()}").cast("int").alias("alt_count")) for b in "ACGT"])
    keep = [c for c in counts.columns if c not in ("n_a", "n_c", "n_g", "n_t")]
    rows = counts.select(*[q(c) for c in keep], F.inline(bases)).where((F.col("alt_count") > 0) & (F.col("alt") != F.col(q(reference))))
    rows = rows.withColumn("fraction", F.col("alt_count") / F.col("depth"))
    return rows.withColumn("p_value", binomial_upper_tail(F.col("alt_count"), F.col("depth").cast("int"), error))


def gated(variants: DataFrame, *, min_depth: int = 20, least: float = 0.1, min_reads: int = 3, max_p: float = 1e-3, fixed: float = 0.9) -> DataFrame:
    """Variants at sites of enough depth and share of the reads which also have enough reads and are unlikely by error, or
    are fixed (a fixed one needs neither). Adds ``is_fixed``."""
    v = variants.withColumn("is_fixed", F.col("fraction") >= fixed)
    return v.where((F.col("depth") >= min_depth) & (F.col("fraction") >= least) & (F.col("is_fixed") | ((F.col("alt_count") >= min_reads) & (F.col("p_value") <= max_p))))


def site_lists(
    counts: DataFrame, keys: Sequence[str], position: str, length: str, *, min_depth: int = 5, mixed: tuple[float, float] = (0.2, 0.8), mixed_depth: int = 20,
    min_indels: int = 3, indel_share: float = 0.2,
) -> DataFrame:
    """Per key ``breadth_pct`` (places of the length at ``min_depth``), ``mean_depth`` (of places with any), and the places in
    order ``indel_sites`` (enough tokens that insert or delete) and ``mixed_sites`` (the most frequent base has a
    share within ``mixed``)."""
    depth, p = F.col("depth"), F.col(q(position))
    deep = depth >= min_depth
    top = F.greatest("n_a", "n_c", "n_g", "n_t")
    indel = deep & (top > 0) & (F.col("n_indel") >= F.greatest(F.lit(float(min_indels)), indel_share * depth))
    half = deep & (depth >= mixed_depth) & (top / depth).between(*mixed)
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, p)))
    return counts.groupBy(*[q(k) for k in keys]).agg(
        (100.0 * F.count_if(deep) / F.max(q(length))).alias("breadth_pct"), F.avg(F.when(depth > 0, depth)).alias("mean_depth"), listed(indel).alias("indel_sites"), listed(half).alias("mixed_sites")
    )


def variant_rows(variants: DataFrame, catalog: DataFrame, *, synonymous: bool = False, names: int = 6) -> DataFrame:
    """What is reported of gated variants: ``reference``, ``gene``, ``start``, ``end``, ``method``, ``n_changes``,
    ``changes``, ``depth``, ``alt_count``, ``fraction``, ``status``.

    ``variants`` holds ``reference``, ``gene``, ``length``, ``position``, ``change``, ``synonymous``, ``depth``, ``alt_count``,
    ``fraction``, ``is_fixed``; ``catalog`` ``gene`` and ``change``, compared regardless of case. Synonymous ones are left out.
    A catalogued variant is POINTR, one that isn't VARIANTR; fixed ones that no catalogue has only say that the
    database lacks this allele, so they are folded into one ALLELER row for each reference and gene, over its whole
    length, with the first ``names`` changes in order of place.
    """
    known = catalog.select(F.lower("gene").alias("_g"), F.upper("change").alias("_c")).where("_g IS NOT NULL AND _c IS NOT NULL").distinct().withColumn("_known", F.lit(True))
    v = variants if synonymous else variants.where(~F.coalesce("synonymous", F.lit(False)))
    v = v.join(known, (F.lower("gene") == F.col("_g")) & (F.upper("change") == F.col("_c")), "left")
    listed = F.coalesce("_known", F.lit(False))
    single = v.where(listed | ~F.col("is_fixed")).select(
        "reference", "gene", F.col("position").alias("start"), F.col("position").alias("end"), F.when(listed, "POINTR").otherwise("VARIANTR").alias("method"), F.lit(1).cast("bigint").alias("n_changes"),
        F.col("change").alias("changes"), F.col("depth").cast("bigint").alias("depth"), F.col("alt_count").cast("bigint").alias("alt_count"), "fraction",
        F.when(F.col("is_fixed"), "FIXED").otherwise("HETERORESISTANT").alias("status"),
    )
    each = F.sort_array(F.collect_list(F.struct("position", "change", "depth", "alt_count")))
    fold = v.where(~listed & F.col("is_fixed")).groupBy("reference", "gene").agg(each.alias("m"), F.max("length").alias("length"))
    text = F.concat(F.array_join(F.transform(F.slice("m", 1, names), lambda x: x["change"]), ", "), F.when(F.size("m") > names, ", ...").otherwise(""))
    folded = fold.select(
        "reference", "gene", F.lit(1).alias("start"), F.col("length").alias("end"), F.lit("ALLELER").alias("method"), F.size("m").cast("bigint").alias("n_changes"), text.alias("changes"),
        F.col("m")[0]["depth"].cast("bigint").alias("depth"), F.col("m")[0]["alt_count"].cast("bigint").alias("alt_count"), F.lit(None).cast("double").alias("fraction"), F.lit("ALLELE").alias("status"),
    )
    return single.unionByName(folded)


def site_rows(calls: DataFrame, *, absent: bool = False) -> DataFrame:
    """Reported rows of catalogued sites (see allele_fractions, with ``symbol``): those that are fixed or heteroresistant
    (all with ``absent``), with ``identity_pct`` (100, or what the share leaves at an absent one) and ``note``."""
    rows = calls if absent else calls.where(F.col("status").isin("fixed", "heteroresistant"))
    identity = F.when(F.col("status") == "absent", 100.0 * (1.0 - F.col("fraction"))).otherwise(100.0)
    tail = F.when(F.col("status") == "heteroresistant", "; HETERORESISTANT").when(F.col("status") == "fixed", "; FIXED").otherwise("")
    note = F.concat(F.format_string("%s; AF=%.3f; %d/%d reads", "symbol", "fraction", "n_alt", "depth"), tail)
    return rows.withColumn("identity_pct", identity).withColumn("note", note)
