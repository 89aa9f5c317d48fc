"""Tables written for people and other programs. Rounding happens here only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = ("sample", "database", "gene", "accession", "product", "element_type", "element_subtype", "drug_class", "subclass", "sequence", "start", "end", "strand", "coverage", "coverage_pct", "identity_pct", "gaps", "depth", "allele_fraction", "method", "resolution", "primary", "note")
PLACES = {"coverage_pct": 2, "identity_pct": 2, "depth": 2, "allele_fraction": 4}


def long_table(hits: DataFrame) -> DataFrame:
    """The public columns in their order (those that ``hits`` has), drug_class as class, numbers rounded."""
    shown = [c for c in LONG if c in hits.columns]
    return hits.select(*[(F.bround(c, PLACES[c]) if c in PLACES else F.col(c)).alias("class" if c == "drug_class" else c) for c in shown])


def element_table(hits: DataFrame) -> DataFrame:
    """One row for each element with its target and reference length."""
    return hits.select(
        "sample", F.col("sequence").alias("contig"), "start", "end", "strand", F.col("gene").alias("element"), F.col("product").alias("name"), "element_type", "element_subtype",
        F.col("drug_class").alias("class"), "subclass", "method", (F.abs(F.col("end") - F.col("start")) + 1).alias("target_length"), F.element_at(F.split("coverage", "/"), -1).try_cast("int").alias("reference_length"),
        F.bround("coverage_pct", 2).alias("coverage_pct"), F.bround("identity_pct", 2).alias("identity_pct"), "accession",
    )


def sample_documents(hits: DataFrame) -> DataFrame:
    """``sample``, ``document``: a JSON text for each sample with its hits in order. A sample's hits are one genome's."""
    fields = [c for c in LONG if c in hits.columns and c != "sample"]
    ordered = F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in fields])))
    return hits.where("sample IS NOT NULL").groupBy("sample").agg(F.to_json(F.struct(ordered.alias("hits"))).alias("document"))


def write_table(df: DataFrame, path: str, *, sep: str = "\t", single: bool = False) -> None:
    """A separated text with a header; ``single`` asks for one file (only for what fits a task).

    Tab-separated fields aren't quoted: tabs and line ends in them become blanks. Other separators are quoted.
    """
    out = df.coalesce(1) if single else df
    if sep == "\t":
        out = out.select(*[F.regexp_replace(c, r"[\t\r\n]", " ").alias(c) if t == "string" else F.col(c) for c, t in out.dtypes])
        out.write.mode("overwrite").csv(path, sep=sep, header=True, nullValue="", emptyValue="", quote="")
    else:
        out.write.mode("overwrite").csv(path, sep=sep, header=True, nullValue="", emptyValue="", escape='"')
