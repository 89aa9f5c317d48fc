"""Catalogued mutations looked up in the alignments of each sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strainspark.functions.names import is_mutant
from strainspark.functions.sequences import aligned_residues
from strainspark.operators.ranking import best_per_key


def best_locus(hsps: DataFrame) -> DataFrame:
    """Of each sample and reference the HSPs of the contig piece with the highest summed score (of equals the first by name)."""
    total = hsps.groupBy("sample", "sseqid", "qseqid").agg(F.sum("bitscore").alias("total"))
    top = best_per_key(total, ["sample", "sseqid"], [F.desc("total"), F.col("qseqid")]).select("sample", "sseqid", "qseqid")
    return hsps.join(top, ["sample", "sseqid", "qseqid"], "left_semi")


def call_mutations(hsps: DataFrame, pieces: DataFrame, catalog: DataFrame, *, nucleotide: bool = True) -> DataFrame:
    """``sample``, ``sseqid``, ``position``, ``symbol``, ``ref``, ``alt``, ``observed``, ``reference``, ``hsp_id``, ``mutant``: each entry of the
    catalogue at each sample whose alignment covers it.

    ``catalog`` holds ``sseqid``, ``position``, ``symbol``, ``ref``, ``alt``. Only references of the catalogue are read (a
    semi join), of each sample's best locus; an entry is looked up in the HSP with the highest score that
    covers all its residues (of equals the lowest id). HSPs without alignment strings cover nothing. Entries
    and records that are repeated count once.
    """
    e = catalog.select("sseqid", "position", "symbol", "ref", "alt").where("position > 0").distinct()
    h = hsps.where("qseq IS NOT NULL AND sseq IS NOT NULL AND bitscore IS NOT NULL AND NOT isnan(bitscore)").dropDuplicates(["hsp_id"])
    h = h.join(e.select("sseqid").distinct(), "sseqid", "left_semi").join(pieces.select(F.col("qid").alias("qseqid"), "sample").distinct(), "qseqid")
    h = best_locus(h).withColumn("lo", F.least("sstart", "send")).withColumn("hi", F.greatest("sstart", "send"))
    last = F.col("position") + F.greatest(F.length(F.coalesce("ref", F.lit(""))), F.lit(1)) - 1
    met = h.join(e.withColumnRenamed("sseqid", "_s"), (F.col("sseqid") == F.col("_s")) & (F.col("position") >= F.col("lo")) & (last <= F.col("hi")))
    first = Window.partitionBy("sample", "sseqid", "position", "symbol", "ref", "alt").orderBy(F.desc("bitscore"), "hsp_id")
    met = met.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("last", last)
    residues = F.filter(aligned_residues(F.col("qseq"), F.col("sseq"), F.col("sstart"), F.col("send"), nucleotide=nucleotide), lambda x: x.position.between(F.col("position"), F.col("last")))
    seen = met.withColumn("_r", F.array_sort(residues))
    text = lambda name: F.array_join(F.transform("_r", lambda x: x[name]), "")
    seen = seen.withColumn("observed", text("observed")).withColumn("reference", text("reference"))
    return seen.select("sample", "sseqid", "position", "symbol", "ref", "alt", "observed", "reference", "hsp_id", is_mutant(F.col("ref"), F.col("alt"), F.col("observed"), F.col("reference")).alias("mutant"))


def mutation_summary(calls: DataFrame) -> DataFrame:
    """Per sample: entries looked up, mutants, and their symbols in order."""
    return calls.groupBy("sample").agg(F.count(F.lit(1)).alias("n_sites"), F.count_if("mutant").alias("n_mutant"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("mutant"), F.col("symbol")))), ",").alias("mutants"))
