"""From HSPs, pieces and reference metadata to hits: the nucleotide screen as one plan over all samples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainspark.functions.names import coverage_string, natural_key
from strainspark.operators.hsps import merge_hsps
from strainspark.operators.overlap import greedy_dedup
from strainspark.session import materialize

#: Identity below the threshold at which HSPs still take part: merging can raise a hit's identity.
SLACK = 5.0
#: Least identity and coverage of a hit, in percent, unless its database has its own.
MIN_IDENTITY, MIN_COVERAGE = 80.0, 60.0


def located(hits: DataFrame, pieces: DataFrame) -> DataFrame:
    """Hits on pieces as hits on contigs: ``sample``, ``contig``, ``start``, ``end`` in the contig's coordinates.

    An inner join; a hit on an unknown piece falls away, a piece listed twice counts once.
    """
    p = pieces.where("qid IS NOT NULL").groupBy("qid").agg(F.min(F.struct("sample", "contig", "piece_offset")).alias("p")).select("qid", "p.*")
    j = hits.join(p, F.col("qseqid") == F.col("qid"))
    return j.withColumn("start", F.col("query_start") + F.coalesce("piece_offset", F.lit(0))).withColumn("end", F.col("query_end") + F.coalesce("piece_offset", F.lit(0))).drop("qid", "piece_offset")


def annotated(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """Hits with their reference's metadata; those without any keep empty strings. A reference listed twice counts once."""
    fields = ["gene", "accession", "product", "class", "subclass", "element_type", "element_subtype"]
    m = meta.groupBy("seqid").agg(F.min(F.struct(*fields)).alias("m"))
    j = hits.join(m, F.col("sseqid") == F.col("seqid"), "left")
    return j.select(*hits.columns, *[F.coalesce(F.col("m." + f), F.lit("")).alias("drug_class" if f == "class" else f) for f in fields])


def thresholds(hits: DataFrame, limits: Mapping[str, tuple[float, float]] | None = None, *, identity: float = MIN_IDENTITY, coverage: float = MIN_COVERAGE, database: str = "database") -> DataFrame:
    """Hits at or above the identity and coverage asked for, which ``limits`` may set by database."""
    i, c = F.lit(identity), F.lit(coverage)
    for name, (a, b) in (limits or {}).items():
        i, c = F.when(F.col(database) == name, a).otherwise(i), F.when(F.col(database) == name, b).otherwise(c)
    return hits.where((F.col("identity_pct") >= i) & (F.col("coverage_pct") >= c))


def screen(hsps: DataFrame, pieces: DataFrame, meta: DataFrame, *, limits: Mapping[str, tuple[float, float]] | None = None, identity: float = MIN_IDENTITY, coverage: float = MIN_COVERAGE, fraction: float = 0.5) -> DataFrame:
    """One row for each element found: HSPs pre-filtered, merged, filtered, put on their contigs, annotated, and of
    hits of one database that overlap by ``fraction`` the best kept (by score, then the lower gene name in natural
    order). The database is the reference's name up to its last '_'.
    """
    least = min([identity, *(a for a, _ in (limits or {}).values())])
    merged = merge_hsps(hsps.where(F.col("pident") >= least - SLACK)).withColumn("database", F.regexp_extract("sseqid", r"^(.*)_[^_]*$", 1))
    found = annotated(located(thresholds(merged, limits, identity=identity, coverage=coverage), pieces), meta)
    found = found.withColumn("hit", F.concat_ws("|", "qseqid", "sseqid", "query_start", "strand"))
    order = [(F.col("bitscore"), "desc"), (F.array_join(F.transform(natural_key(F.col("gene")), lambda x: F.concat(F.when(x.tag == 1, F.lit("~")).otherwise(""), F.lpad(x.number.cast("string"), 38, "0"), x.letter)), ""), "asc")]
    # Read twice, for the order of the suppression and for what it keeps: the merged hits are folded once.
    found = materialize(found, "screened")
    kept = greedy_dedup(found, ["database", "sample", "contig"], "start", "end", "hit", order, fraction=fraction)
    whole = F.col("coverage_pct") >= 100
    return kept.select(
        "sample", "database", "gene", "accession", "product", "element_type", "element_subtype", "drug_class", "subclass", F.col("contig").alias("sequence"), "start", "end", "strand",
        coverage_string(F.col("subject_intervals"), F.col("slen")).alias("coverage"), "coverage_pct", "identity_pct", "gaps", "bitscore",
        F.when(whole, "BLASTN").otherwise("PARTIALN").alias("method"), F.when(whole, "COMPLETE").otherwise("PARTIAL").alias("resolution"),
    )
