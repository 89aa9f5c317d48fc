"""Report tables over hits: orders, layouts, views, filters, the typing table and the summary with its leading columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strainspark.columns import q
from strainspark.functions.names import coverage_glyph

#: Orders of hits: by what they are, and by where they are. hit_id decides ties.
BY_NAME = ("sample", "element_type", "drug_class", "gene", "hit_id")
BY_PLACE = ("sample", "sequence", "start", "end", "hit_id")


def ordered(hits: DataFrame, order: Sequence[str]) -> DataFrame:
    """All hits in ``order``, nulls last: a range partitioned sort."""
    return hits.orderBy(*[F.col(q(c)).asc_nulls_last() for c in order])


def placed(hits: DataFrame, order: Sequence[str]) -> DataFrame:
    """``hits`` with ``place``, the row's number in ``order`` within its first column (a sample's rows are sorted together)."""
    w = Window.partitionBy(q(order[0])).orderBy(*[F.col(q(c)).asc_nulls_last() for c in order[1:]])
    return hits.withColumn("place", F.row_number().over(w))


def gene_layout(hits: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each hit, primary or not, in the columns that scripts expect. ``files`` names each ``sample``'s ``file``;
    a sample without one is named itself. RESISTANCE is the subclass, or the class."""
    f = files.where("sample IS NOT NULL").groupBy("sample").agg(F.min("file").alias("file"))
    h = hits.join(f, "sample", "left")
    return h.select(
        F.coalesce("file", "sample").alias("#FILE"), F.col("sequence").alias("SEQUENCE"), F.col("start").alias("START"), F.col("end").alias("END"), F.col("strand").alias("STRAND"),
        F.col("gene").alias("GENE"), F.col("coverage").alias("COVERAGE"), coverage_glyph(F.col("coverage")).alias("COVERAGE_MAP"), F.col("gaps").alias("GAPS"),
        F.round("coverage_pct", 2).alias("%COVERAGE"), F.round("identity_pct", 2).alias("%IDENTITY"), F.col("database").alias("DATABASE"), F.col("accession").alias("ACCESSION"),
        F.col("product").alias("PRODUCT"), F.coalesce(F.nullif("subclass", F.lit("")), F.nullif("drug_class", F.lit("")), F.lit("")).alias("RESISTANCE"),
    )


def mixed_sites(hits: DataFrame, *, methods: Sequence[str] = ("POINTR",)) -> DataFrame:
    """Resistance mutations measured from reads (by one of the ``methods``), with their share of the reads and status (from
    the note)."""
    note = F.upper(F.coalesce("note", F.lit("")))
    status = F.when(F.contains(note, F.lit("HETERORESISTANT")), "heteroresistant").when(F.contains(note, F.lit("FIXED")), "fixed").otherwise("detected")
    return hits.where(F.col("allele_fraction").isNotNull() & F.col("method").isin(list(methods)) & (F.col("element_type") == "AMR")).select(
        "hit_id", "sample", "gene", F.substring_index("note", ";", 1).alias("mutation"), F.col("drug_class").alias("class"), "subclass", F.round("allele_fraction", 4).alias("allele_fraction"),
        "depth", status.alias("status"), F.col("sequence").alias("reference"), F.col("start").alias("position"),
    )


def acquired(hits: DataFrame, suppress: DataFrame, *, plus: bool = False, identity: float = 90.0, coverage: float = 50.0) -> DataFrame:
    """Hits of acquired genes: not of an accession that is suppressed (``accession``, an anti join), no reference of point
    mutations, of resistance only unless ``plus``, at the least coverage and identity."""
    own = hits.where((F.coalesce("element_subtype", F.lit("")) != "POINT") & (F.col("coverage_pct") >= coverage) & (F.col("identity_pct") >= identity))
    own = own if plus else own.where(F.coalesce("element_type", F.lit("AMR")) == "AMR")
    return own.join(suppress.where("accession IS NOT NULL").select("accession").distinct(), "accession", "left_anti")


def typing_table(calls: DataFrame, samples: DataFrame, schemes: Sequence[str]) -> DataFrame:
    """One row per sample: ``sample``, ``species`` and for each scheme its call and ``<scheme>_lineage``.

    ``calls`` holds ``sample``, ``scheme``, ``call``, ``lineage``; of several calls of one scheme the highest stays (with
    its lineage). Every sample keeps a row.
    """
    best = F.max(F.struct("call", "lineage"))
    wide = calls.where("sample IS NOT NULL AND call IS NOT NULL").groupBy("sample").pivot("scheme", list(schemes)).agg(best)
    named = [x for s in schemes for x in (F.col(f"{q(s)}.call").alias(s), F.col(f"{q(s)}.lineage").alias(f"{s}_lineage"))]
    own = samples.where("sample IS NOT NULL").groupBy("sample").agg(F.min("species").alias("species"))
    return own.join(wide, "sample", "left").select("sample", "species", *named)


def full_summary(samples: DataFrame, typing: DataFrame, counts: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """One row per sample, leading columns first: ``sample``, ``input_type`` (assembly, reads, both or none), ``species``,
    then those of the typing table, the counts (null ones are 0) and ``warnings``, joined by '; ' in order."""
    has = lambda c: F.max(F.coalesce(F.trim(c) != "", F.lit(False)))
    own = samples.where("sample IS NOT NULL").groupBy("sample").agg(has("assembly").alias("a"), has("r1").alias("r"), F.min("species").alias("species"))
    kind = F.when(F.col("a") & F.col("r"), "both").when(F.col("a"), "assembly").when(F.col("r"), "reads").otherwise("none")
    lead = own.select("sample", kind.alias("input_type"), "species")
    out = lead.join(typing.drop("species"), "sample", "left").join(counts, "sample", "left")
    out = out.fillna(0, subset=[c for c in counts.columns if c != "sample"])
    if warnings is not None:
        told = warnings.where("warning <> ''").groupBy("sample").agg(F.array_join(F.array_sort(F.collect_set("warning")), "; ").alias("warnings"))
        out = out.join(told, "sample", "left").withColumn("warnings", F.coalesce("warnings", F.lit("")))
    return out


def cards(hits: DataFrame, samples: DataFrame) -> DataFrame:
    """One row over everything: samples, species, hits, primary hits, genes and classes."""
    h = hits.agg(
        F.count(F.lit(1)).alias("n_hits"), F.count_if("primary").alias("n_primary"), F.count_distinct(F.nullif(F.trim("gene"), F.lit(""))).alias("n_genes"),
        F.count_distinct(F.nullif("drug_class", F.lit(""))).alias("n_classes"),
    )
    s = samples.agg(F.count_distinct("sample").alias("n_samples"), F.count_distinct(F.nullif(F.trim("species"), F.lit(""))).alias("n_species"))
    return h.withColumn("_k", F.lit(1)).join(s.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row each
