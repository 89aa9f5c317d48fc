"""Tab-separated files: aligner output, sample sheets, tables with a checked header, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainspark.columns import q

HSP_FIELDS = (
    ("qseqid", "string"), ("sseqid", "string"), ("pident", "double"), ("length", "int"), ("mismatch", "int"), ("gapopen", "int"), ("qstart", "int"), ("qend", "int"),
    ("sstart", "int"), ("send", "int"), ("evalue", "double"), ("bitscore", "double"), ("slen", "int"), ("qlen", "int"), ("gaps", "int"), ("nident", "int"),
)


def read_hsps(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The table hsps from an aligner's 16 tab-separated fields (18 with the alignment strings).

    Comments, blank and short lines are left out; a number that can't be read is 0; the strand is '+' where
    the reference counts up.
    """
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("value NOT LIKE '#%' AND trim(value) <> ''").select(f.alias("f")).where(F.size("f") >= len(HSP_FIELDS))
    number = lambda i, t: F.coalesce(F.get("f", F.lit(i)).try_cast(t), F.lit(0).cast(t))
    columns = [(F.get("f", F.lit(i)) if t == "string" else number(i, t)).alias(n) for i, (n, t) in enumerate(HSP_FIELDS)]
    more = [F.get("f", F.lit(16)).alias("qseq"), F.get("f", F.lit(17)).alias("sseq")]
    return rows.select(*columns, *more).withColumn("strand", F.when(F.col("send") >= F.col("sstart"), "+").otherwise("-"))


def read_table(spark: SparkSession, path: str | list[str], needed: Sequence[str], *, sep: str = "\t") -> DataFrame:
    """A table with a header line ('#' before it is dropped), all strings; short rows are filled with ''.

    Raises ValueError with the names that are missing.
    """
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, quote="" if sep == "\t" else '"', escape='"' if sep != "\t" else None, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = df.toDF(*[c.lstrip("#").strip() for c in df.columns])
    if missing := [n for n in needed if n not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.fillna("")


def read_sample_sheet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, rejected): ``sample``, ``assembly``, ``r1``, ``r2`` of a sheet without a header.

    Fields are parted by tabs, or by commas in a line without one; '#' begins a comment. A line without a sample
    or without any file is rejected with its text and the reason.
    """
    lines = spark.read.text(path).where("trim(value) <> '' AND value NOT LIKE '#%'")
    f = F.when(F.instr("value", "\t") > 0, F.split("value", "\t")).otherwise(F.split("value", ","))
    part = lambda i: F.nullif(F.trim(F.get(f, F.lit(i))), F.lit(""))
    rows = lines.select("value", part(0).alias("sample"), part(1).alias("assembly"), part(2).alias("r1"), part(3).alias("r2"))
    reason = F.when(F.col("sample").isNull(), "no sample").when(F.coalesce("assembly", "r1").isNull(), "no file").when(F.col("r2").isNotNull() & F.col("r1").isNull(), "mate without its first")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason IS NULL").drop("value", "reason"), rows.where("reason IS NOT NULL").select("value", "reason")


def long_profiles(df: DataFrame, st: str, loci: Sequence[str]) -> DataFrame:
    """``st``, ``locus``, ``allele``: a wide profile table in long form, empty cells left out."""
    return df.unpivot(q(st), [q(x) for x in loci], "locus", "allele").where("allele <> ''").withColumnRenamed(st, "st")
