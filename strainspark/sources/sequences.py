"""FASTA and FASTQ files as tables."""

from __future__ import annotations

import bz2
import gzip
import lzma
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FASTA = "path string, header string, seq string"


def _records(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Splits at '>' that begin a line come in order; what stands before a file's first one is no record."""
    at = None
    for block in it:
        out = []
        for path, start, value in zip(block["path"], block["start"], block["value"]):
            first = start == 0 and path != at
            at = path
            if first:
                if not value.startswith(">"):
                    continue
                value = value[1:]
            header, _, rest = value.partition("\n")
            header = header.rstrip("\r")
            if header.strip():
                out.append((path, header, "".join(rest.split())))
        yield pd.DataFrame(out, columns=["path", "header", "seq"])


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path``, ``header``, ``seq`` of each record. Blank lines, carriage returns and text before the first record
    are left out; the header stays whole. gz and bz2 are read as they are; large plain files are split."""
    raw = spark.read.option("lineSep", "\n>").option("recursiveFileLookup", "true").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    return raw.mapInPandas(_records, FASTA)


def sequences_by_id(fasta: DataFrame) -> DataFrame:
    """``id`` (the header's first word), ``seq``: of records that share an id the last by header and sequence."""
    return fasta.select(F.regexp_extract("header", r"^(\S*)", 1).alias("id"), "header", "seq").groupBy("id").agg(F.max(F.struct("header", "seq")).alias("m")).select("id", "m.seq")


def write_fasta(df: DataFrame, header: str, seq: str, path: str, *, width: int = 60) -> None:
    """One text file per partition: '>header', then the sequence in lines of ``width``."""
    wrapped = F.regexp_replace(F.coalesce(F.col(seq), F.lit("")), f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), F.col(header), F.when(F.length(wrapped) > 0, F.concat(F.lit("\n"), wrapped)).otherwise(""))).write.mode("overwrite").text(path)


def _opened(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    raw = system.open_input_file(inner)
    for ending, module in ((".gz", gzip), (".bz2", bz2), (".xz", lzma)):
        if path.endswith(ending):
            return module.open(raw, "rt", errors="replace")
    import io

    return io.TextIOWrapper(raw, errors="replace")


def _reads(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for block in it:
        for path in block["path"]:
            with _opened(path) as lines:
                rows, n = [], 0
                while True:
                    name, seq, _, quality = (lines.readline() for _ in range(4))
                    if not quality.strip():
                        break
                    rows.append((path, n, name.strip().lstrip("@"), seq.strip(), quality.strip()))
                    n += 1
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["path", "n", "name", "seq", "quality"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "n", "name", "seq", "quality"])


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path``, ``n`` (from 0), ``name``, ``seq``, ``quality`` of each record, up to a file's first without a quality line.

    Files are listed by Spark and streamed by the tasks, one file in one task (compressed reads can't be
    split); plain, gz, bz2 and xz; bytes that can't be decoded are replaced.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    n = max(1, min(files.count(), 10_000))
    return files.repartition(n).mapInPandas(_reads, "path string, n bigint, name string, seq string, quality string")
