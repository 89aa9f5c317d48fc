"""Loser tree and top-N against sorting."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strainspark.llm.topn import LoserTree, top_n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), max_size=8).map(sorted), min_size=1, max_size=9))
def test_loser_tree_merges(runs):
    its = [iter(r) for r in runs]
    tree, out = LoserTree([next(i, None) for i in its]), []
    while (x := tree.heads[tree.winner]) is not None:
        out.append(x)
        tree.replace(next(its[tree.winner], None))
    assert out == sorted(x for r in runs for x in r)


SCHEMA = "id bigint, g string, score double, tie double, rank2 string"
row = st.tuples(st.integers(0, 30), st.sampled_from(["x", "y", "", None]), st.sampled_from([1.0, 2.5, -1.0, 0.0, -0.0, None, math.nan]), st.sampled_from([1.0, 2.0, None]), st.just("s"))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, max_size=40), st.integers(1, 4))
def test_against_sorting(spark, rows, n):
    rows = list({r[0]: r for r in rows}.values())
    df = spark.createDataFrame(rows + rows[:7], SCHEMA).repartition(3)
    got = sorted((r["g"], r["rank"], r["id"]) for r in top_n(df, "g", "score", [("tie", "desc")], "id", n, buckets=5).collect())
    want = []
    for g in {r[1] for r in rows if r[1] is not None}:
        own = sorted((r for r in rows if r[1] == g and r[2] is not None and not math.isnan(r[2])), key=lambda r: (-r[2], r[3] is None, -(r[3] or 0), r[0]))
        want += [(g, i + 1, r[0]) for i, r in enumerate(own[:n])]
    assert got == sorted(want)


def test_hot_group_and_many_runs(spark):
    df = spark.range(20000, numPartitions=7).selectExpr("id", "IF(id % 3 = 0, 'hot', CAST(id % 500 AS string)) AS g", "CAST((id * 7919) % 1000 AS double) AS score")
    got = {(r["g"], r["id"]) for r in top_n(df, "g", "score", [], "id", 5).collect()}
    rows = [(r["g"], -r["score"], r["id"]) for r in df.collect()]
    want = set()
    for g in {r[0] for r in rows}:
        want |= {(g, r[2]) for r in sorted(x for x in rows if x[0] == g)[:5]}
    assert got == want


def test_empty(spark):
    assert top_n(spark.createDataFrame([], SCHEMA), "g", "score", [], "id", 3).collect() == []


def test_merge_holds_one_open_piece_of_each_run():
    """Runs of many small pieces come in by their first group; groups go on over pieces; no more is held than is due."""
    import random

    import pyarrow as pa

    from strainspark.llm import topn

    rng = random.Random(4)
    rows, pieces = [], []
    for run in range(7):
        own = sorted((f"g{rng.randrange(60):02d}", float(rng.randrange(50)), run * 10_000 + k) for k in range(600))
        rows += own
        for k in range(0, len(own), 16):
            part = own[k : k + 16]
            batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], ["g", "s", "i"])
            pieces.append((part[0][0], run, k, topn._pack(batch)))
    pieces.sort(key=lambda p: p[:3])
    taken = []

    def source():
        for g, run, _, raw in pieces:
            taken.append(g)
            yield g, run, raw

    got, most = [], 0
    for key in topn.merge_runs(source(), 3, 3):
        got.append(key)
        # Pieces taken in whose first group lies ahead of what is put out.
        most = max(most, sum(g > key[0] for g in taken))
    want = []
    for g in sorted({r[0] for r in rows}):
        want += sorted(r for r in rows if r[0] == g)[:3]
    assert got == want and most <= topn.AHEAD + 1
