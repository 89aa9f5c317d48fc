"""Readers and writers on small files."""

import bz2
import gzip
import lzma

import pytest

from strainspark.session import materialize, remove, scratch, shared_dir
from strainspark.sources.sequences import read_fasta, read_fastq, sequences_by_id, write_fasta
from strainspark.sources.tabular import read_hsps, read_sample_sheet, read_table
from strainspark.streaming.arrivals import drain, read_arrivals, windowed_counts


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text("preamble\n>x one\r\nAC\r\n\nGT\n>y>z\nTT\n>x two\nGG")
    (tmp_path / "b.fa").write_text(">only\n")
    with gzip.open(tmp_path / "c.fa.gz", "wt") as f:
        f.write(">c\nAAA\n")
    got = sorted((r["header"], r["seq"]) for r in read_fasta(spark, str(tmp_path)).collect())
    assert got == [("c", "AAA"), ("only", ""), ("x one", "ACGT"), ("x two", "GG"), ("y>z", "TT")]
    assert {r["id"]: r["seq"] for r in sequences_by_id(read_fasta(spark, str(tmp_path))).collect()} == {"c": "AAA", "only": "", "x": "GG", "y>z": "TT"}
    out = str(tmp_path / "out")
    write_fasta(spark.createDataFrame([("h", "ACGTACG"), ("e", None)], "h string, s string"), "h", "s", out, width=3)
    assert sorted((r["header"], r["seq"]) for r in read_fasta(spark, out).collect()) == [("e", ""), ("h", "ACGTACG")]


def test_fastq(spark, tmp_path):
    text = "@r1 x\nACGT\n+\nIIII\n@r2\nAC\n+\nII\n@cut\nAC\n"
    (tmp_path / "a.fastq").write_text(text)
    for name, module in (("b.fastq.gz", gzip), ("c.fastq.bz2", bz2), ("d.fastq.xz", lzma)):
        with module.open(tmp_path / name, "wt") as f:
            f.write(text)
    got = read_fastq(spark, str(tmp_path)).collect()
    assert len(got) == 8 and {(r["n"], r["name"], r["seq"], r["quality"]) for r in got} == {(0, "r1 x", "ACGT", "IIII"), (1, "r2", "AC", "II")}


def test_tables(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("# comment\n\nq\ts\t99.5\t10\tx\t0\t1\t10\t20\t11\t1e-5\t50\t100\t200\t0\t9\nshort\tline\n")
    r = read_hsps(spark, str(tmp_path / "h.tsv")).collect()
    assert len(r) == 1 and (r[0]["mismatch"], r[0]["evalue"], r[0]["strand"], r[0]["qseq"]) == (0, 1e-5, "-", None)
    (tmp_path / "t.tsv").write_text("#a\tb\tc\n1\t\"x\"\n2\ty\tz\n")
    assert sorted(tuple(x) for x in read_table(spark, str(tmp_path / "t.tsv"), ["a", "b"]).collect()) == [("1", '"x"', ""), ("2", "y", "z")]
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "t.tsv"), ["d"])
    (tmp_path / "s.tsv").write_text("# sheet\ns1\ta.fa\ns2\t\tr1.fq\tr2.fq\ns3,b.fa\n\tx.fa\ns4\t\t\tr2.fq\n")
    good, bad = read_sample_sheet(spark, str(tmp_path / "s.tsv"))
    assert sorted(tuple(x) for x in good.collect()) == [("s1", "a.fa", None, None), ("s2", None, "r1.fq", "r2.fq"), ("s3", "b.fa", None, None)]
    assert sorted(r["reason"] for r in bad.collect()) == ["no file", "no sample"]


def test_profile_table_has_every_database(spark, data):
    from strainspark.queries.files import profile_table_all

    h = spark.read.parquet(f"{data}/hits.parquet").where("sample IS NOT NULL AND database IS NOT NULL")
    want = {r[0] for r in h.select("database").distinct().collect()}
    assert len(want) > 3 and {r["locus"] for r in profile_table_all(spark, data).select("locus").distinct().collect()} == want


def test_every_hit_is_in_the_long_table_and_the_documents(spark, data):
    from strainspark.queries.files import hits_json_all, hits_long_all
    from strainspark.queries.ranked import hits

    h = hits(spark, data)
    n, deep, named, bare = h.selectExpr("count(*)", "count(depth)", "count(sample)", "count_if(sample IS NOT NULL AND start IS NULL)").first()
    assert deep and bare
    assert tuple(hits_long_all(spark, data).selectExpr("count(*)", "count(depth)").first()) == (n, deep)
    assert hits_json_all(spark, data).selectExpr("sum(n)").first()[0] == named


def test_shared_folder(spark):
    assert shared_dir(spark).startswith("file:/")
    path = scratch(spark, "x")
    spark.range(3).write.parquet(path)
    remove(spark, path)
    assert materialize(spark.range(3), "y").count() == 3


def test_stream(spark, tmp_path):
    schema = "id bigint, ts timestamp, kind string"
    make = lambda rows: spark.createDataFrame(rows, "id bigint, t string, kind string").selectExpr("id", "CAST(t AS timestamp) AS ts", "kind")
    make([(1, "2024-01-01 00:10:00", "a"), (1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 00:20:00", "a"), (3, "2024-01-01 05:00:00", "b")]).coalesce(1).write.parquet(str(tmp_path / "in"))
    counts = windowed_counts(read_arrivals(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), "ts", ["kind"], row_id="id")
    drain(counts, str(tmp_path / "out"), str(tmp_path / "state"))
    make([(9, "2024-01-01 00:15:00", "a"), (10, "2024-01-01 12:00:00", "b")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    drain(counts, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(str(r["window_start"]), r["kind"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("2024-01-01 00:00:00", "a", 2) in got and not any(n == 3 for _, _, n in got)
    table = windowed_counts(spark.read.parquet(str(tmp_path / "in")), "ts", ["kind"], row_id="id")
    assert {(r["kind"], r["n"]) for r in table.collect()} == {("a", 3), ("b", 1)}
