"""Values and the entries that they mean."""

from strainspark.llm.canonical import canonicalise, contained, distance, normalise

ENTRIES = [(1, "New York"), (2, "Newark"), (3, "San Francisco"), (4, "San Salvador"), (5, None), (6, " ")]


def mapped(spark, values, **kw):
    v = spark.createDataFrame([(x, "y") for x in values], "city string, entry string")
    e = spark.createDataFrame(ENTRIES, "id int, name string")
    return {r["city"]: r["entry_id"] for r in canonicalise(v, "city", e, entry_id="id", entry="name", **kw).collect()}


def test_threshold_and_margin(spark):
    got = mapped(spark, ["new york", "NEW-YORK ", "San Fransisco", "Sán Salvadór", "Paris", "san", None, " ", "???", "Newark", "Newark"], threshold=0.5)
    assert got == {"new york": 1, "NEW-YORK ": 1, "San Fransisco": 3, "Sán Salvadór": 4, "Paris": None, "san": None, "???": None, "Newark": 2}


def test_long_and_empty(spark):
    long = " ".join("".join(chr(97 + (i * k * 7) % 26) for k in range(1, 7)) for i in range(9000)) + " New York"
    assert mapped(spark, [long, "New York" * 9000], threshold=0.5) == {long: None, "New York" * 9000: 1}
    assert mapped(spark, []) == {}


def test_required(spark):
    e = spark.createDataFrame([(1, "Bekalon family class A reviarine permease", ["bekalon", "permease"]), (2, "Bekalon family reviarine hydrolase", ["bekalon", "hydrolase"]), (3, "Kudutas family sensor kinase", ["kudutas", "sensor kinase"])], "entry_id int, entry string, need array<string>")
    v = spark.createDataFrame([(x,) for x in ("bekaoln fam. permease", "reviarine hydrolase of Bekalon", "Bekalon family efflux pump", "Zuradon family hydrolase", "kinase, sensor Kudutas", "KUDUTAS SENS. KINSE")], "v string")
    got = {r["v"]: r["entry_id"] for r in canonicalise(v, "v", e, required="need").collect()}
    assert got == {"bekaoln fam. permease": 1, "reviarine hydrolase of Bekalon": 2, "Bekalon family efflux pump": None, "Zuradon family hydrolase": None, "kinase, sensor Kudutas": 3, "KUDUTAS SENS. KINSE": 3}


def test_required_whatever_the_cosine(spark):
    """Text around the phrases doesn't lower their cosine; the entry is that of the check over all entries."""
    families, acts = ("fupigus", "bekalon", "kudutas", "ginosox", "valomas", "nidivur"), ("chromate permease", "sensor kinase", "efflux pump", "hydrolase")
    listed = [(i, f"{f} family class A {c} {a}", [f, a]) for i, (f, c, a) in enumerate(((f, c, a) for f in families for c, a in zip(("reviarine", "sofeozin", "nusaozin", "pasuetin"), acts)), 1)]
    e = spark.createDataFrame(listed, "entry_id int, entry string, need array<string>")
    wrapped = [w.format(x) for x in ("Fuipgus fam. chrom. permease", "bekaoln hydrolase", "kudtuas sens. kinase", "Zuradon fam. chrom. permease", "Ginosox fam. chrom. phosphotransferase") for w in ("{}", "predicted: MULTI: {}", "conserved hypothetical low quality protein: putative {} [fragment] (partial)")]
    v = spark.createDataFrame([(x,) for x in wrapped], "v string")
    rows = {r["v"]: (r["entry_id"], r["score"]) for r in canonicalise(v, "v", e, required="need").collect()}
    for k, x in enumerate(wrapped):
        bare = rows[wrapped[k - k % 3]]
        assert rows[x][0] == bare[0] and (bare[1] is None or rows[x][1] >= bare[1])
    found = {x: [i for i, _, p in listed if distance(normalise(x), p, 2, False)] for x in wrapped}
    assert {x: [i] if i else [] for x, (i, _) in rows.items()} == found and sum(map(len, found.values())) == 9


def test_several(spark):
    e = spark.createDataFrame([(1, "SOFEOZIN", ["sofeozin"]), (2, "GOFUULFAN", ["gofuulfan"]), (3, "DUGOULFAN", ["dugoulfan"])], "entry_id int, entry string, need array<string>")
    v = spark.createDataFrame([("sofeozin + DUGO-ULFAN",), ("dugoulfan",), ("SOFEOZ.",), ("other",)], "v string")
    rows = canonicalise(v, "v", e, required="need", several=True, n=2, threshold=0.2).collect()
    assert {(r["v"], r["entry_id"]) for r in rows} == {("sofeozin + DUGO-ULFAN", 1), ("sofeozin + DUGO-ULFAN", 3), ("dugoulfan", 3), ("SOFEOZ.", 1), ("other", None)}


def test_helpers():
    assert normalise("  Zotafath_fámily X­-Y. ") == "zotafath family x y."
    assert contained("abcd", "xxabdcxx", 2)[0] == 1 and contained("abcd", "xyz", 1)[0] == 2
    assert distance("rib. protection prot.", ["ribosomal protection protein"], 2)[0] == 0
    assert distance("efflux", ["permease"], 2) is None


def test_close_scores_are_decided_by_edits(spark):
    e = spark.createDataFrame([(1, "abcdefgh permease", ["abcdefgh", "permease"]), (2, "abcdefgz permease", ["abcdefgz", "permease"]), (3, "abcdefgh permease", ["abcdefgh", "permease"])], "entry_id int, entry string, need array<string>")
    v = spark.createDataFrame([("abcdefgz permease",), ("abcdefgh permease",)], "v string")
    got = {r["v"]: r["entry_id"] for r in canonicalise(v, "v", e, required="need", margin=0.9).collect()}
    assert got == {"abcdefgz permease": 2, "abcdefgh permease": None}


def test_long_list_is_joined_by_a_shuffle(spark, monkeypatch):
    from strainspark.llm import canonical

    values = ["new york", "San Fransisco", "Paris", "Newark 7"]
    want = mapped(spark, values, threshold=0.5)
    monkeypatch.setattr(canonical, "FEW", 0)
    assert mapped(spark, values, threshold=0.5) == want and want["San Fransisco"] == 3


def test_candidates_against_all_entries(spark, data):
    """Recall: on every product of the smallest tables the entry is the one that the exact check over all entries leaves."""
    from strainspark.llm.q_canonical import _odd, product_entries, products

    listed = [(r["entry_id"], [normalise(p) for p in r["required"]]) for r in product_entries(spark, data).collect()]
    got = {r["product"]: r["entry_id"] for r in products(spark, data).collect()}
    values = [r["product"] for r in _odd(spark, data, "product").select("product").distinct().collect()]
    assert set(values) == set(got)
    named = {v: [i for i, p in listed if distance(normalise(v), p, 2, False)] for v in values}
    sure = {v: x for v, x in named.items() if x}
    assert len(sure) > 20 and sum(got[v] in x for v, x in sure.items()) >= 0.99 * len(sure)


def test_digits_in_one_entry_change_no_other_value(spark):
    e = spark.createDataFrame([(1, "alpha kinase"), (2, "beta permease")], "entry_id int, entry string")
    more = e.union(spark.createDataFrame([(3, "omega 77 pump")], "entry_id int, entry string"))
    v = spark.createDataFrame([("alpha kinase 12",), ("beta permease",)], "v string")
    one, two = ({r["v"]: r["entry_id"] for r in canonicalise(v, "v", x).collect()} for x in (e, more))
    assert one == two == {"alpha kinase 12": 1, "beta permease": 2}
