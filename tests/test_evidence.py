"""Search by seeds, coverage calls, closest alleles, profiles, annotation, against plain loops and fixed values."""

import random

from pyspark.sql import functions as F

from strainspark.functions.names import file_format, marker_stem
from strainspark.operators.alleles import allele_fractions
from strainspark.operators.annotation import fill_from_group, prefix_related, transfer
from strainspark.operators.calls import best_reference, closest_alleles, disrupted, divergent, marker_variants, reference_coverage
from strainspark.operators.matrix import cell, matrix
from strainspark.operators.profiles import allele_notation, lookup, nearest, scheme_scores
from strainspark.operators.ranking import latest_records, preferred
from strainspark.operators.seeds import search
from strainspark.operators.sketch import distances, sketches
from strainspark.operators.summaries import concordance

RNG = random.Random(11)
dna = lambda n: "".join(RNG.choice("ACGT") for _ in range(n))


def test_planted_genes_are_found(spark):
    genes = {f"g{i}": dna(200) for i in range(8)}
    contigs, want = [], set()
    for i, (g, s) in enumerate(genes.items()):
        bad = list(s)
        for at in RNG.sample(range(200), 20):  # 90 % identity
            bad[at] = RNG.choice("ACGT".replace(bad[at], ""))
        contigs.append((f"c{i}", dna(150) + "".join(bad) + dna(100)))
        want.add((f"c{i}", g))
    contigs += [("none", None), ("short", "ACGT"), ("n", "N" * 50)]
    got = search(spark.createDataFrame(contigs, "qseqid string, seq string"), spark.createDataFrame(list(genes.items()), "sseqid string, seq string"), k=11, gap=60, min_length=60).collect()
    assert {(r["qseqid"], r["sseqid"]) for r in got} == want
    assert all(r["qstart"] - r["sstart"] == 150 and r["length"] == r["qend"] - r["qstart"] + 1 and 80 <= r["pident"] < 100 for r in got)


def test_exact_match_places(spark):
    s = dna(60)
    got = search(spark.createDataFrame([("q", "TT" + s[5:50] + "G")], "qseqid string, seq string"), spark.createDataFrame([("s", s)], "sseqid string, seq string"), k=11).collect()
    r = max(got, key=lambda r: r["nident"])
    assert r["nident"] >= 45 and r["qstart"] <= 3 <= r["qend"] and r["sstart"] - r["qstart"] == 3


def test_matches_are_extended_on_both_strands(spark):
    other = lambda b: "ACGT"[("ACGT".index(b) + 1) % 4]
    s = dna(80)
    t = s[10:40]
    t = t[:15] + other(t[15]) + t[16:]  # two of 30 bases differ, no seeded span of 20
    t = t[:4] + other(t[4]) + t[5:15] + t[15:]
    minus = s[30:70][::-1].translate(str.maketrans("ACGT", "TGCA"))
    x = spark.createDataFrame([("f", t), ("r", minus)], "qseqid string, seq string")
    got = {r["qseqid"]: r for r in search(x, spark.createDataFrame([("s", s)], "sseqid string, seq string"), k=11).collect()}
    f, r = got["f"], got["r"]
    assert (f["qstart"], f["qend"], f["sstart"], f["send"], f["length"], f["nident"]) == (1, 30, 11, 40, 30, 28)
    assert (r["qstart"], r["qend"], r["sstart"], r["send"], r["nident"]) == (1, 40, 70, 31, 40)


def test_cassette_coverage(spark):
    df = spark.createDataFrame([("x", "II(2A)", 1, 5000, 10000), ("x", "II(2A)", 4900, 9800, 10000), ("x", "IV", 1, 9799, 10000), ("y", "II(2A)", 1, 2100, 10000)], "sample string, ref string, lo int, hi int, n int")
    c = reference_coverage(df, ["sample"], "ref", "lo", "hi", "n")
    assert {(r["sample"], r["call"]) for r in best_reference(c, ["sample"], "ref").collect()} == {("x", "II(2A)"), ("y", "none")}


def test_closest_alleles(spark):
    c = spark.createDataFrame([("s", "l", "ACGTN"), ("t", "l", "AAAAA"), ("u", "m", "A")], "sample string, locus string, seq string")
    a = spark.createDataFrame([("l", "2", "ACGTT"), ("l", "1", "ACGTA"), ("l", "3", "ACG"), ("l", "9", "AAAAT")], "locus string, allele string, seq string")
    assert {(r["sample"], r["allele"], r["n_same"]) for r in closest_alleles(c, a, ["sample"], "locus").collect()} == {("s", "1", 4), ("t", "9", 4)}


def test_marker_variants(spark):
    rows = [("s", f"delete_rmpA_{i}", 90.0 + i) for i in range(1, 6)] + [("s", "other_1", 50.0), ("t", "delete_rmpA_1", 10.0)]
    df = spark.createDataFrame(rows, "sample string, gene string, identity double")
    assert {(r["sample"], r["gene"]) for r in marker_variants(df, ["sample"], "gene", marker_stem(F.col("gene")), [F.desc("identity")]).collect()} == {("s", "delete_rmpA_5"), ("s", "other_1"), ("t", "delete_rmpA_1")}


PROFILES = [("1478", "a", "1"), ("1478", "b", "2"), ("1478", "c", "3"), ("18", "a", "1"), ("18", "b", "2"), ("18", "c", "4"), ("66", "a", "1"), ("66", "b", "5"), ("66", "c", "9")]


def test_profiles(spark):
    p = spark.createDataFrame([(*r, "L1" if r[0] != "66" else "L2") for r in PROFILES], "st string, locus string, allele string, lin string")
    calls = spark.createDataFrame([("x", "a", "1"), ("x", "b", "2"), ("x", "c", "3"), ("y", "a", "1"), ("y", "b", "2"), ("z", "a", "7"), ("w", "a", "1"), ("w", "b", "2"), ("w", "c", "8"), ("v", "a", None)], "sample string, locus string, allele string")
    exact = {r["sample"]: (r["st"], r["rivals"]) for r in lookup(calls, p, "sample", "st", "locus", "allele").collect()}
    assert exact == {"x": ("1478", ""), "y": (None, ""), "z": (None, ""), "w": (None, ""), "v": (None, "")}
    wild = {r["sample"]: (r["st"], r["rivals"]) for r in lookup(calls, p, "sample", "st", "locus", "allele", missing=1).collect()}
    assert wild["y"] == ("1478", "18") and wild["x"] == ("1478", "") and wild["w"][0] is None
    near = {r["sample"]: (r["st"], r["n_shared"], r["n_equal"], r["lineage"]) for r in nearest(calls, p, "sample", "st", "locus", "allele", lineage="lin").collect()}
    assert near == {"x": ("1478", 3, 1, "L1"), "y": ("1478", 2, 2, "L1"), "w": ("1478", 2, 2, "L1")}


def test_every_rival_is_named(spark):
    p = spark.range(1500).selectExpr("id AS st", "'a' AS locus", "'1' AS allele")
    calls = spark.createDataFrame([("x", "a", "1")], "sample string, locus string, allele string")
    r = lookup(calls, p, "sample", "st", "locus", "allele").first()
    assert r["st"] == 0 and r["rivals"].split(", ") == [str(i) for i in range(1, 1500)]


def test_notation_and_scheme(spark):
    df = spark.createDataFrame([("1", 100.0, 100.0), ("2", 99.0, 100.0), ("3", 100.0, 80.0), (None, None, None)], "a string, i double, c double")
    assert [r[0] for r in df.select(allele_notation(F.col("a"), F.col("i"), F.col("c"))).collect()] == ["1", "~2", "3?", "-"]
    best = spark.createDataFrame([("s", sch, f"l{i}", 100.0 if i < n else 99.0, 100.0) for sch, m, n in (("ecoli", 8, 8), ("kleb", 7, 5)) for i in range(m)], "sample string, scheme string, locus string, i double, c double")
    loci = best.select("scheme", "locus").distinct()
    got = {r["scheme"]: (r["n_exact"], r["place"], r["accepted"]) for r in scheme_scores(best, loci, ["sample"], "scheme", "locus", "i", "c").collect()}
    assert got == {"ecoli": (8, 1, True), "kleb": (5, 2, True)}


def test_annotation(spark):
    df = spark.createDataFrame([("g1", ["x", "blax"]), ("g2", ["y"]), ("g3", [])], "g string, keys array<string>")
    known = spark.createDataFrame([("blax", "c1", "t1"), ("y", "c2", "t2"), ("y", "c2", "t2")], "k string, class string, type string")
    assert {tuple(r) for r in transfer(df, "g", "keys", known, "k", ["class", "type"]).collect()} == {("g1", "c1", "t1"), ("g2", "c2", "t2")}
    f = spark.createDataFrame([("a", "s", 1), ("a", None, 2), ("b", "s", 3), ("b", "t", 4), ("b", None, 5), (None, None, 6)], "g string, v string, n int")
    assert {r["n"]: r["v"] for r in fill_from_group(f, "g", "v").collect()} == {1: "s", 2: "s", 3: "s", 4: "t", 5: None, 6: None}
    a = spark.createDataFrame([("Esch",), ("Esch_coli",), ("Kleb_pneu",)], "x string")
    b = spark.createDataFrame([("Esch",), ("Esch_coli",), ("Kleb",), ("Kl",)], "y string")
    assert sorted(tuple(r) for r in prefix_related(a, "x", b, "y").collect()) == [("Esch", "Esch"), ("Esch", "Esch_coli"), ("Esch_coli", "Esch"), ("Esch_coli", "Esch_coli"), ("Kleb_pneu", "Kleb")]


def test_ranking(spark):
    df = spark.createDataFrame([(1, "2024", "old"), (1, "2025", "new"), (None, "1", "x"), (None, "2", "y")], "id int, v string, s string")
    assert sorted(r["s"] for r in latest_records(df, "id", "v").collect()) == ["new", "x", "y"]
    p = spark.createDataFrame([("g", "a", 9.0), ("g", "b", 8.5), ("g", "c", 5.0), ("g", "d", 4.0)], "k string, n string, m double")
    assert {r["n"]: r["place"] for r in preferred(p, ["k"], [F.desc("m")], "m", top=3, within=1.0, forced=F.col("n") == "d").collect()} == {"a": 1, "b": 2, "d": 4}


def test_matrix_keeps_empty_rows(spark):
    df = spark.createDataFrame([("s1", "x", 1.0), ("s1", "x", 2.0), ("s2", "y", 3.0), (None, "y", 1.0), ("s2", None, 1.0)], "sample string, gene string, identity_pct double")
    rows = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "sample string")
    assert {tuple(r) for r in matrix(df, "sample", "gene", cell("count"), rows=rows).collect()} == {("s1", 2, 0), ("s2", 0, 1), ("s3", 0, 0)}
    assert matrix(df.limit(0), "sample", "gene", cell("count"), rows=rows).count() == 3
    assert {tuple(r) for r in matrix(df, "sample", "gene", cell("identity"), absent=None).collect()} == {("s1", 2.0, None), ("s2", None, 3.0)}


def test_fractions_and_concordance(spark):
    df = spark.createDataFrame([("p", i < 93) for i in range(464)] + [("q", False)] * 30 + [("r", True)] * 5, "site string, alt boolean")
    got = {r["site"]: r for r in allele_fractions(df, ["site"], F.col("alt")).collect()}
    assert got["p"]["status"] == "heteroresistant" and got["p"]["p_value"] < 1e-150 and got["q"]["status"] == "absent" and got["r"]["status"] == "low-depth"
    a = spark.createDataFrame([("s", "x"), ("s", "y"), ("t", "x")], "k string, g string")
    b = spark.createDataFrame([("s", "x"), ("u", "z"), ("s", "x")], "k string, g string")
    assert {tuple(r) for r in concordance(a, b, ["k"], "g").collect()} == {("s", 1, 1, 0, 0.5), ("t", 0, 1, 0, 0.0), ("u", 0, 0, 1, 0.0)}


def test_sketches(spark):
    s = dna(400)
    other = dna(400)
    df = spark.createDataFrame([("same", s), ("half", s[:200] + other[:200]), ("far", other), ("none", None)], "k string, t string")
    d = {r["k"]: r for r in distances(sketches(df.where("k <> 'same'"), "k", "t", k=11, size=2000), sketches(df.where("k = 'same'").selectExpr("k AS r", "t"), "r", "t", k=11, size=2000), "k", "r", k=11, size=2000).collect()}
    assert set(d) == {"half"} or d["half"]["jaccard"] > d.get("far", {"jaccard": 0})["jaccard"]
    assert 0.2 < d["half"]["jaccard"] < 0.5 and d["half"]["distance"] > 0


def test_disrupted_and_divergent(spark):
    h = spark.createDataFrame([("s", "mgrB", "K", 1, 64, 100, 87.0), ("t", "mgrB", "E", 1, 64, 100, 87.0), ("u", "mgrB", None, 1, 64, 100, 87.0), ("v", "mgrB", "K", 1, 95, 100, 99.0), ("w", "mgrB", "K", 1, 64, 100, 70.0), ("x", "ompK", "K", 1, 50, 100, 99.0), ("y", "mgrB", "K", 1, 10, 100, 99.0)], "sample string, gene string, org string, sstart int, send int, slen int, pident double")
    rules = spark.createDataFrame([("mgrB", 80.0, ["K"])], "gene string, min_identity double, organisms array<string>")
    assert [(r["sample"], r["coverage_pct"]) for r in disrupted(h, rules, ["sample"], organism="org").collect()] == [("s", 64.0)]
    hits = spark.createDataFrame([(1, "a", 90.0), (2, "a", 99.0), (3, "b", 10.0)], "id int, acc string, identity_pct double")
    cut = spark.createDataFrame([("a", 95.0), ("a", 97.0), ("c", 1.0), ("b", None)], "acc string, cutoff double")
    assert [r["id"] for r in divergent(hits, cut, "acc").collect()] == [1]
    df = spark.createDataFrame([("x.fa.gz", None), ("x.FQ", None), ("x", " >a"), ("x.txt", "@r"), ("x", "z"), (None, ">")], "p string, h string")
    assert [r[0] for r in df.select(file_format(F.col("p"), F.col("h"))).collect()] == ["fasta", "fastq", "fasta", "fastq", "", None]
