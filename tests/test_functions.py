"""Column functions at fixed values."""

import math

from pyspark.sql import functions as F

from strainspark.functions import names, sequences, stats
from strainspark.operators.alleles import base_counts, consensus
from strainspark.operators.summaries import length_stats


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


def many(spark, values, f):
    return [r["x"] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v")).alias("x")).collect()]


def test_sequences(spark):
    assert many(spark, ["ACGTN", "acgr", None, ""], sequences.revcomp) == ["NACGT", "ycgt", None, ""]
    assert many(spark, ["ATGGCCTAA", "augn", "AT", "", None], sequences.translate_codons) == ["MA*", "M", "", "", None]
    assert many(spark, ["GTGNNN"], lambda c: sequences.translate_codons(c, start_is_met=True)) == ["MX"]
    assert many(spark, ["GGCCAANN", "NN"], sequences.gc_percent) == [100 * 4 / 6, None]
    assert many(spark, ["ATG" * 20, "ATGTAA" * 10, "ATG" * 19 + "TAA" + "", "A" * 61], sequences.looks_like_cds) == [True, False, True, False]
    assert many(spark, ["!+5"], sequences.phred_sum) == [0 + 10 + 20]


def test_pieces(spark):
    offsets = lambda n, c, o: [x["piece_offset"] for x in many(spark, ["A" * n], lambda v: sequences.pieces(v, c, o))[0]]
    assert offsets(1000, 400, 100) == [0, 300, 600] and offsets(100, 40, 100) == [0, 30, 60] and offsets(400, 400, 100) == [0] and offsets(401, 400, 100) == [0, 300]
    got = many(spark, ["ABCDEFGHIJ"], lambda v: sequences.pieces(v, 4, 1))[0]
    assert [x["piece"] for x in got] == ["ABCD", "DEFG", "GHIJ"]


def test_alignment(spark):
    walk = lambda q, s, a, b: [tuple(x) for x in one(spark, "q string, s string, a int, b int", (q, s, a, b), sequences.aligned_residues(F.col("q"), F.col("s"), F.col("a"), F.col("b")))]
    assert walk("AC-GT", "ACGGT", 1, 5)[2:4] == [(3, "-", "G", 2), (4, "G", "G", 2)]
    assert walk("AXC", "A-C", 10, 11) == [(10, "A", "A", 0), (11, "C", "C", 2)]
    assert walk("AC", "AG", 9, 8) == [(9, "T", "T", 0), (8, "G", "C", 1)]


def test_codon_change(spark):
    f = sequences.codon_change(F.col("s"), F.col("p"), F.col("a"))
    assert tuple(one(spark, "s string, p int, a string", ("ATGGCC", 4, "A"), f)) == (2, "A", "T", False)
    assert tuple(one(spark, "s string, p int, a string", ("ATGGCC", 6, "T"), f)) == (2, "A", "A", True)
    assert one(spark, "s string, p int, a string", ("ATGG", 4, "T"), f) is None


def test_symbols(spark):
    got = [tuple(r) for r in many(spark, ["gyrA_S83L", "pbp4_T-266A", "mgrB_Q30STOP", "nfsB_W94Ter", "ampC_G-15GG", "odd"], names.parse_symbol)]
    assert got == [("gyrA", "S", 83, "L"), ("pbp4", "T", -266, "A"), ("mgrB", "Q", 30, "*"), ("nfsB", "W", 94, "*"), ("ampC", "G", -15, "GG"), ("odd", "", None, "")]
    rows = [("G", "T"), ("G", "GG"), ("T", "TGT"), ("A", "del"), ("W", "*"), ("G", "G"), ("", "A"), ("GA", "G"), ("GA", "TT")]
    df = spark.createDataFrame(rows, "r string, a string")
    assert [x[0] for x in df.select(names.change_type(F.col("r"), F.col("a"))).collect()] == ["substitution", "insertion", "insertion", "deletion", "nonsense", "complex", "complex", "deletion", "complex"]
    assert [x[0] for x in df.select(names.inserted_bases(F.col("r"), F.col("a"))).collect()][1:3] == ["G", "GT"]


def test_names(spark):
    assert many(spark, ["blaKPC-2_1_AY034847", "ARR-2_1", "(AGly)AAC(6')-Isa", "1567214_ble", "123_45", "aac_x 1", "aph(3'')-Ia"], names.gene_key) == ["blakpc-2", "arr-2", "aac(6')-isa", "1567214_ble", "123_45", "aacx1", "aph(3'')-ia"]
    assert many(spark, ["OXA-48", "blaNDM-1", "tetA"], names.lookup_keys) == [["oxa-48", "blaoxa-48"], ["blandm-1"], ["teta"]]
    order = sorted(["blaSHV-11", "blaSHV-2", "blaSHV-67", "blaSHV-a"], key=dict(zip(["blaSHV-11", "blaSHV-2", "blaSHV-67", "blaSHV-a"], many(spark, ["blaSHV-11", "blaSHV-2", "blaSHV-67", "blaSHV-a"], names.natural_key))).get)
    assert order == ["blaSHV-a", "blaSHV-2", "blaSHV-11", "blaSHV-67"]
    assert many(spark, ["/x/a.b_R1_001.fastq.gz", "y.fa", "z_2.fq.xz", ".fa"], lambda c: names.sample_name(c, reads=True)) == ["a.b", "y", "z", "sample"]
    assert many(spark, ["a b/c", "__", "x.y-z_"], names.safe_name) == ["a_b_c", "sample", "x.y-z"]
    assert [tuple(x) for x in many(spark, ["db~~~g~~~acc~~~a b~~~c", "db~~~g~~~acc some words", "tok the rest", "tok"], names.parse_header)] == [("g", "acc", "a b~~~c"), ("g", "acc", "some words"), ("tok", "tok", "the rest"), ("tok", "tok", "")]
    assert many(spark, ["1-50/100", "1-20,81-100/100", "x", "1-5/0", None], names.coverage_glyph) == ["========.......", "===.........===", "", "", None]
    assert many(spark, ["ACC@23S_ribosomal_RNA@23S:1-5", "ACC@blaSHV_promoter", None], names.is_multicopy_rrna) == [True, False, False]


def test_binomial(spark):
    def tail(k, n, p):
        return one(spark, "k int, n int", (k, n), stats.binomial_upper_tail(F.col("k"), F.col("n"), p))

    assert abs(tail(21, 464, 0.002) / 1.105e-21 - 1) < 1e-2 and abs(math.log10(tail(93, 464, 0.002)) - math.log10(1.99e-152)) < 0.01
    assert tail(0, 5, 0.1) == 1 and tail(6, 5, 0.1) == 0 and tail(1, 5, 0.0) == 0 and tail(1, 5, 1.0) == 1
    assert abs(tail(1, 5000, 0.5) - 1) < 1e-9 and abs(tail(2, 3, 0.5) - 0.5) < 1e-12


def test_pileup_tokens(spark):
    df = spark.createDataFrame([(1, t) for t in ("A", "A+2GT", "*", "T-1N", "C")] + [(2, "*")], "pos int, token string")
    got = {r["pos"]: r for r in base_counts(df, ["pos"], "token").collect()}
    assert (got[1]["n_a"], got[1]["n_t"], got[1]["n_indel"], got[1]["depth"], got[1]["base"]) == (2, 1, 3, 5, "A") and got[2]["base"] is None


def test_consensus_has_the_length_of_its_reference(spark):
    df = spark.createDataFrame([("x", 3, "A", 2, 8), ("x", 4, "C", 1, 8), ("x", 6, "G", 2, 8), ("y", 2, None, 1, None), ("y", 0, "T", 9, None)], "k string, p int, b string, n int, slen int")
    got = {r["k"]: (r["consensus"], r["n_called"]) for r in consensus(df, ["k"], "p", "b", "n", min_depth=2, length="slen").collect()}
    assert got == {"x": ("NNANNGNN", 2), "y": ("NN", 0)}


def test_length_stats(spark):
    df = spark.createDataFrame([("a", n) for n in (80, 70, 50, 40, 30, 20)] + [("b", 5), ("b", None), ("b", 0)], "k string, n int")
    got = {r["k"]: (r["n"], r["total"], r["largest"], r["n50"], r["n90"]) for r in length_stats(df, ["k"], "n").collect()}
    assert got == {"a": (6, 290, 80, 70, 30), "b": (1, 5, 5, 5, 5)}
