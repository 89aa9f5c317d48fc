"""Report tables, headers, variants and sketches on small cases."""

import random

from pyspark.sql import functions as F

from strainspark.functions import headers as hd
from strainspark.functions.names import is_multicopy_rrna
from strainspark.operators.reports import acquired, full_summary, mixed_sites, ordered, placed, typing_table
from strainspark.operators.sketch import distances, nearest, sketches
from strainspark.operators.variants import alternate_bases, gated, site_lists, site_rows, variant_rows


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("r")).first()["r"]


def test_headers(spark):
    p = one(spark, "99|WP_1|1|1|blaX|fam|mutation|1|a_b|beta-lactam|some_protein", hd.protein_header)
    assert (p["accession"], p["gene"], p["part_of_gene"], p["subclass"], p["class"], p["product"]) == ("WP_1", "blaX", "mutation", "A B", "BETA-LACTAM", "some protein")
    assert one(spark, "WP_1|1", hd.protein_header)["product"] == "" and one(spark, None, hd.protein_header) is None
    assert tuple(one(spark, "P|N|1|1|g|f|id two_words", hd.piped_header)) == ("g", "N", "two words")
    assert tuple(one(spark, "P||1|1||f|alone", hd.piped_header)) == ("f", "P", "alone") and one(spark, "a|b", hd.piped_header) is None
    assert tuple(one(spark, "gb|ACC|+|1-9|ARO:1|OXA-1 [Escherichia coli]", hd.ontology_header)) == ("OXA-1", "ACC", "Escherichia coli")
    assert tuple(one(spark, "aph(3')-Ia_9_EU12 text", hd.copied_header)) == ("aph(3')-Ia", "EU12", "") and tuple(one(spark, "x_1", hd.copied_header)) == ("x_1", "", "")
    assert tuple(one(spark, "VF1(gb|WP_9) (entA) enterobactin [Iron] [E. coli]", hd.bracketed_header)) == ("entA", "WP_9", "enterobactin")
    assert tuple(one(spark, "other thing", hd.bracketed_header)) == ("other", "", "other thing")
    assert tuple(one(spark, "ecoli.adk.1.2", hd.locus_id)) == ("ecoli", "adk", "1.2") and tuple(one(spark, "ybt#irp1.5", hd.locus_id)) == ("ybt", "irp1", "5")
    assert one(spark, "a.b", hd.locus_id) is None
    names = {"Escherichia_coli/GCF_1.fna.gz": "Escherichia coli", "GCF_000.fna.gz": "", "a/b/klebsiella_sp/x": "Klebsiella sp.", "9x/y": "", "": "", "Genus.fasta": "Genus"}
    assert {k: one(spark, k, hd.taxon_of_path) for k in names} == names


def test_rrna(spark):
    assert [one(spark, x, is_multicopy_rrna) for x in ("16S", "x_23s|y", "116S", "16Sx", "ribosomal RNA", "rrnA", None, "")] == [True, True, False, False, True, True, False, False]


def test_orders(spark):
    rows = [(1, "b", "AMR", None, "g"), (2, "a", None, "x", "g"), (3, "a", "AMR", "x", "h"), (4, "a", "AMR", "x", "g")]
    df = spark.createDataFrame(rows, "hit_id int, sample string, element_type string, drug_class string, gene string")
    order = ["sample", "element_type", "drug_class", "gene", "hit_id"]
    assert [r["hit_id"] for r in ordered(df, order).collect()] == [4, 3, 2, 1]
    assert {r["hit_id"]: r["place"] for r in placed(df, order).collect()} == {4: 1, 3: 2, 2: 3, 1: 1}


def test_typing_and_summary(spark):
    calls = spark.createDataFrame([("s", "m", "5", "L"), ("s", "m", "7", None), ("t", "n", None, "x"), (None, "m", "1", "")], "sample string, scheme string, call string, lineage string")
    samples = spark.createDataFrame([("s", "a.fna", None, "E"), ("s", "a.fna", None, "E"), ("t", " ", "r", None), ("u", None, None, None), (None, "x", None, None)], "sample string, assembly string, r1 string, species string")
    wide = typing_table(calls, samples, ["m", "n"])
    got = {r["sample"]: r for r in wide.collect()}
    assert got["s"]["m"] == "7" and got["s"]["m_lineage"] is None and got["t"]["n"] is None and set(got) == {"s", "t", "u"}
    counts = spark.createDataFrame([("s", 3)], "sample string, k bigint")
    told = spark.createDataFrame([("s", "b"), ("s", "a"), ("s", "b"), ("t", "")], "sample string, warning string")
    full = full_summary(samples, wide, counts, told)
    assert full.columns[:3] == ["sample", "input_type", "species"]
    r = {x["sample"]: (x["input_type"], x["k"], x["warnings"]) for x in full.collect()}
    assert r == {"s": ("assembly", 3, "a; b"), "t": ("reads", 0, ""), "u": ("none", 0, "")}


def test_filters(spark):
    rows = [(1, "A", "AMR", "POINT", 99.0, 99.0), (2, "A", "AMR", "AMR", 99.0, 99.0), (3, "S", "AMR", "AMR", 99.0, 99.0), (4, None, None, None, 90.0, 50.0), (5, "A", "STRESS", "STRESS", 99.0, 99.0), (6, "A", "AMR", "AMR", 89.0, 99.0)]
    h = spark.createDataFrame(rows, "hit_id int, accession string, element_type string, element_subtype string, identity_pct double, coverage_pct double")
    sup = spark.createDataFrame([("S",), (None,)], "accession string")
    assert {r["hit_id"] for r in acquired(h, sup).collect()} == {2, 4} and {r["hit_id"] for r in acquired(h, sup, plus=True).collect()} == {2, 4, 5}
    m = spark.createDataFrame([(1, "POINTR", "x S1L; AF=0.3; Heteroresistant", 0.30004), (2, "POINTR", None, None), (3, "VARIANTR", "y", 0.5)], "hit_id int, method string, note string, allele_fraction double")
    m = m.select("*", F.lit("AMR").alias("element_type"), *[F.lit("").alias(c) for c in ("sample", "gene", "drug_class", "subclass", "sequence")], F.lit(1.0).alias("depth"), F.lit(1).alias("start"))
    r = mixed_sites(m).collect()
    assert [(x["hit_id"], x["mutation"], x["status"], x["allele_fraction"]) for x in r] == [(1, "x S1L", "heteroresistant", 0.3)]
    assert {x["hit_id"]: x["status"] for x in mixed_sites(m, methods=("POINTR", "VARIANTR")).collect()} == {1: "heteroresistant", 3: "detected"}


def test_variants(spark):
    counts = [("r", 1, 30, 0, 70, 0, 0, 100, "G"), ("r", 2, 1, 99, 0, 0, 0, 100, "C"), ("r", 3, 0, 0, 0, 30, 5, 35, "A"), ("r", 4, 2, 0, 0, 3, 0, 5, "T"), ("r", 5, 19, 0, 0, 0, 0, 19, "T")]
    df = spark.createDataFrame(counts, "reference string, position int, n_a bigint, n_c bigint, n_g bigint, n_t bigint, n_indel bigint, depth bigint, base string")
    alts = alternate_bases(df, "base")
    assert {(r["position"], r["alt"], r["alt_count"]) for r in alts.collect()} == {(1, "A", 30), (2, "A", 1), (3, "T", 30), (4, "A", 2), (5, "A", 19)}
    # Two of a hundred are too few, five reads too shallow, 30 of 35 is not fixed but sure.
    assert {(r["position"], r["is_fixed"]) for r in gated(alts).collect()} == {(1, False), (3, False)}
    s = site_lists(df.withColumn("n", F.lit(10)), ["reference"], "position", "n").first()
    assert s["breadth_pct"] == 50.0 and s["indel_sites"] == [] and s["mixed_sites"] == [1]
    v = [("r", "gX", 9, p, c, syn, 50, 45, f, f >= 0.9) for p, c, syn, f in [(1, "S1L", False, 0.5), (2, "A2A", True, 0.5), (3, "T3P", False, 0.95), (4, "Q4R", None, 0.99), (5, "s5k", False, 0.97), (6, "P6L", False, 0.2)]]
    v = spark.createDataFrame(v, "reference string, gene string, length int, position int, change string, synonymous boolean, depth int, alt_count int, fraction double, is_fixed boolean")
    known = spark.createDataFrame([("GX", "S1L"), ("gx", "S5K"), ("gx", "S5K"), (None, "P6L")], "gene string, change string")
    got = {r["changes"]: (r["method"], r["n_changes"], r["start"], r["end"], r["status"]) for r in variant_rows(v, known).collect()}
    assert got == {"S1L": ("POINTR", 1, 1, 1, "HETERORESISTANT"), "s5k": ("POINTR", 1, 5, 5, "FIXED"), "P6L": ("VARIANTR", 1, 6, 6, "HETERORESISTANT"), "T3P, Q4R": ("ALLELER", 2, 1, 9, "ALLELE")}
    calls = spark.createDataFrame([("g_A1T", 20, 5, 0.25, "heteroresistant"), ("g_C2T", 20, 0, 0.0, "absent")], "symbol string, depth int, n_alt int, fraction double, status string")
    assert [r["note"] for r in site_rows(calls).collect()] == ["g_A1T; AF=0.250; 5/20 reads; HETERORESISTANT"]
    assert site_rows(calls, absent=True).count() == 2


def test_sketches_of_sets_of_different_size(spark):
    """A tenth as many: the estimate stays near the true index, which the sketches' own sizes don't give."""
    rng = random.Random(5)
    base = "".join(rng.choice("ACGT") for _ in range(20000))
    df = spark.createDataFrame([("small", base[:2000]), ("large", base)], "k string, t string")
    x = sketches(df.where("k = 'small'"), "k", "t", k=15, size=300)
    y = sketches(df.where("k = 'large'").selectExpr("k AS r", "t"), "r", "t", k=15, size=300)
    r = distances(x, y, "k", "r", k=15, size=300).first()
    true = (2000 - 14) / (20000 - 14)
    assert abs(r["jaccard"] - true) < 0.05
    pairs = spark.createDataFrame([("a", "x", 0.04), ("a", "y", 0.04), ("b", "x", 0.06)], "k string, r string, distance double")
    assert [(n["k"], n["r"]) for n in nearest(pairs, "k", "r").collect()] == [("a", "x")]
