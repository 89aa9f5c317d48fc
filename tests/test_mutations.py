"""Catalogued mutations in hand-made alignments, and one-to-one matches."""

from strainspark.operators.overlap import match_one_to_one
from strainspark.plans.mutations import call_mutations, mutation_summary

HSP = "hsp_id int, qseqid string, sseqid string, sstart int, send int, bitscore double, qseq string, sseq string"


def test_calls(spark):
    hsps = [
        (1, "q1", "r", 1, 6, 50.0, "ACTTAC", "ACGTAC"),
        (2, "q2", "r", 1, 6, 90.0, "AC-TAC", "ACGTAC"),  # the better locus of sample s
        (2, "q2", "r", 1, 6, 90.0, "AC-TAC", "ACGTAC"),
        (3, "q3", "r", 6, 1, 40.0, "GTAAGT", "GTACGT"),  # minus strand of sample t
        (4, "q3", "other", 1, 3, 99.0, "AAA", "AAA"),
        (5, "q3", "r", 1, 6, None, None, None),
    ]
    pieces = spark.createDataFrame([("q1", "s"), ("q2", "s"), ("q3", "t")], "qid string, sample string")
    catalog = spark.createDataFrame([("r", 3, "g_G3T", "G", "T"), ("r", 3, "g_G3del", "G", "del"), ("r", 2, "g_CG2TT", "CG", "TT"), ("r", 3, "g_A3T", "A", "T"), ("r", 50, "far", "A", "T")], "sseqid string, position int, symbol string, ref string, alt string")
    got = {(r["sample"], r["symbol"]): (r["observed"], r["mutant"]) for r in call_mutations(spark.createDataFrame(hsps, HSP), pieces, catalog).collect()}
    assert got == {
        ("s", "g_G3T"): ("-", False), ("s", "g_G3del"): ("-", True), ("s", "g_CG2TT"): ("C-", False), ("s", "g_A3T"): ("-", False),
        ("t", "g_G3T"): ("T", True), ("t", "g_G3del"): ("T", False), ("t", "g_CG2TT"): ("CT", False), ("t", "g_A3T"): ("T", False),
    }
    calls = call_mutations(spark.createDataFrame(hsps, HSP), pieces, catalog)
    assert {tuple(r) for r in mutation_summary(calls).collect()} == {("s", 4, 1, "g_G3del"), ("t", 4, 1, "g_G3T")}


def test_one_to_one(spark):
    a = spark.createDataFrame([(1, "k", 1, 100), (2, "k", 20, 120), (3, "k", 500, 600), (4, "l", 1, 10)], "id int, k string, lo int, hi int")
    b = spark.createDataFrame([(1, "k", 10, 110), (2, "k", 40, 140), (3, "k", 590, 700), (5, None, 1, 10)], "id int, k string, lo int, hi int")
    assert {tuple(r) for r in match_one_to_one(a, b, ["k"], "lo", "hi", "id", width=50).collect()} == {(1, 1), (2, 2)}
