"""Greedy suppression, primary hits, range joins and merged HSPs against plain loops."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strainspark.operators.hsps import merge_hsps
from strainspark.operators.overlap import best_cover, greedy_dedup, islands, locus_primary, overlap_pairs

span = st.tuples(st.sampled_from(["a", "b"]), st.integers(1, 60), st.integers(0, 25), st.integers(0, 4))


def shared(x, y):
    return max(0, min(x[1], y[1]) - max(x[0], y[0]) + 1)


def frame(spark, rows):
    return spark.createDataFrame([(i, k, lo, lo + n, s, "z") for i, (k, lo, n, s) in enumerate(rows)], "id int, k string, lo int, hi int, score int, _lo string")


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(span, max_size=30), st.sampled_from([0.3, 0.5, 1.0]))
def test_greedy(spark, rows, fraction):
    kept = []
    for i in sorted(range(len(rows)), key=lambda i: (-rows[i][3], i)):
        k, lo, n, _ = rows[i]
        if not any(rows[j][0] == k and shared((lo, lo + n), (rows[j][1], rows[j][1] + rows[j][2])) >= fraction * (n + 1) for j in kept):
            kept.append(i)
    got = greedy_dedup(frame(spark, rows), ["k"], "lo", "hi", "id", [(F.col("score"), "desc")], fraction=fraction)
    assert sorted(r["id"] for r in got.collect()) == sorted(kept) and got.columns == ["id", "k", "lo", "hi", "score", "_lo"]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(span, max_size=30))
def test_primary(spark, rows):
    lost = set()
    for key in "ab":
        claimed = []
        for i in sorted((i for i in range(len(rows)) if rows[i][0] == key), key=lambda i: (rows[i][1], rows[i][1] + rows[i][2], i)):
            own = (rows[i][1], rows[i][1] + rows[i][2])
            for place in claimed:
                if shared(own, place[0]) >= 0.6 * min(own[1] - own[0] + 1, place[0][1] - place[0][0] + 1):
                    if rows[i][3] > rows[place[1]][3]:
                        lost.add(place[1])
                        place[:] = [own, i]
                    else:
                        lost.add(i)
                    break
            else:
                claimed.append([own, i])
    got = locus_primary(frame(spark, rows), ["k"], "lo", "hi", "id", [F.col("score")])
    assert {r["id"] for r in got.where("NOT is_primary").collect()} == lost and got.count() == len(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(span, max_size=20), st.lists(span, max_size=20), st.sampled_from([3, 10, 1000]))
def test_pairs(spark, a, b, width):
    got = overlap_pairs(frame(spark, a).drop("_lo"), frame(spark, b).drop("_lo"), ["k"], "lo", "hi", width=width)
    want = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and shared((x[1], x[1] + x[2]), (y[1], y[1] + y[2]))]
    assert sorted((r["a_id"], r["b_id"]) for r in got.collect()) == sorted(want)


def test_islands_use_the_furthest_end(spark):
    df = spark.createDataFrame([("a", 1, 100), ("a", 2, 3), ("a", 90, 95), ("a", 101, 102), ("a", 140, 150)], "k string, lo int, hi int")
    assert [r["island"] for r in islands(df, ["k"], "lo", "hi", gap=5).orderBy("lo").collect()] == [1, 1, 1, 1, 2]


def test_best_cover(spark):
    p = spark.createDataFrame([(1, "a", 5), (2, "a", 50), (3, "b", 5)], "pid int, k string, at int")
    s = spark.createDataFrame([("a", 1, 10, 1.0, "low"), ("a", 4, 6, 2.0, "high"), ("b", 6, 9, 9.0, "off")], "k string, lo int, hi int, score double, name string")
    assert [(r["pid"], r["name"]) for r in best_cover(p, s, ["k"], "at", "pid", "lo", "hi", [F.desc("score")], fields=["name", "score"]).collect()] == [(1, "high")]


HSP = "hsp_id int, qseqid string, sseqid string, strand string, length int, nident int, qstart int, qend int, sstart int, send int, slen int, qlen int, gaps int, evalue double, bitscore double"


def hsp(i, q, s, *, strand="+", slen=100, nident=None, bits=200.0, name=("q", "s")):
    n = s[1] - s[0] + 1
    return (i, *name, strand, n, n if nident is None else nident, *q, *s, slen, 1000, 0, 0.0, bits)


def merged(spark, rows):
    return sorted((r["query_start"], round(r["coverage_pct"], 3), round(r["identity_pct"], 3), r["strand"], r["n_hsps"], len(r["subject_intervals"])) for r in merge_hsps(spark.createDataFrame(rows, HSP)).collect())


def test_merge_fixture_values(spark):
    assert merged(spark, [hsp(1, (1, 50), (1, 50)), hsp(2, (60, 109), (51, 100))]) == [(1, 100.0, 100.0, "+", 2, 1)]
    assert merged(spark, [hsp(1, (1, 100), (1, 100)), hsp(2, (200, 299), (1, 100), strand="-", bits=50.0)]) == [(1, 100.0, 100.0, "+", 1, 1)]
    far = [hsp(1, (1, 450), (1, 450), slen=900), hsp(2, (240_001, 240_450), (451, 900), slen=900)]
    assert merged(spark, far) == [(1, 50.0, 100.0, "+", 1, 1), (240_001, 50.0, 100.0, "+", 1, 1)]
    assert merged(spark, [hsp(1, (1, 50), (1, 50), nident=50), hsp(2, (60, 109), (51, 100), nident=40)])[0][2] == 90.0
    two = [hsp(1, (20_001, 20_100), (1, 100)), hsp(2, (60_862, 60_961), (1, 100)), hsp(2, (60_862, 60_961), (1, 100))]
    assert [(x[0], x[1]) for x in merged(spark, two)] == [(20_001, 100.0), (60_862, 100.0)]
    assert merged(spark, [hsp(1, (1, 50), (1, 50), name=("", "s")), hsp(2, (1, 50), (1, 50), bits=float("nan"))]) == []


def test_merge_random_against_loop(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        s = rng.randrange(1, 80)
        n = rng.randrange(5, 40)
        q = rng.randrange(1, 30_000)
        rows.append(hsp(i, (q, q + n), (s, min(100, s + n)), strand=rng.choice("+-"), bits=float(rng.randrange(20, 60)), nident=rng.randrange(5, n + 1), name=(rng.choice("xy"), rng.choice("st"))))
    want = {}
    for key in {(r[1], r[2], r[3]) for r in rows}:
        own = sorted((r for r in rows if (r[1], r[2], r[3]) == key), key=lambda r: (r[6], r[7], r[0]))
        clusters = []
        for r in own:
            if clusters and r[6] - max(x[7] for x in clusters[-1]) <= 5200:
                clusters[-1].append(r)
            else:
                clusters.append([r])
        for c in clusters:
            kept = []
            for r in sorted(c, key=lambda r: (-r[14], r[0])):
                n = r[9] - r[8] + 1
                if any(shared((r[8], r[9]), (k[8], k[9])) > 0.5 * n for k in kept):
                    continue
                if kept and max(x[7] for x in [*kept, r]) - min(x[6] for x in [*kept, r]) + 1 > 5200:
                    continue
                kept.append(r)
            start = min(k[6] for k in kept)
            place = (key[0], key[1], start // 10_000)
            new = (-sum(k[14] for k in kept), start, key[2], len(kept))
            want[place] = min(want.get(place, new), new)
    got = {(r["qseqid"], r["sseqid"], r["query_start"] // 10_000): (-r["bitscore"], r["query_start"], r["strand"], r["n_hsps"]) for r in merge_hsps(spark.createDataFrame(rows, HSP)).collect()}
    assert got == want
