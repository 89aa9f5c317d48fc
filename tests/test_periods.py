"""Continuous stretches and gaps against brute force over positions."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strainspark.operators.periods import periods_and_gaps, stretches

SCHEMA = "k string, lo int, hi int, kind string"


def brute(rows, only_merged=False):
    out = []
    for k in {r[0] for r in rows}:
        own = {(min(a, b), max(a, b)) for kk, a, b in rows if kk == k and a is not None and b is not None}
        covered = sorted({p for a, b in own for p in range(a, b + 1)})
        runs = []
        for p in covered:
            if runs and runs[-1][1] == p - 1:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        for i, (a, b) in enumerate(runs):
            if not only_merged or sum(a <= x <= b for x, _ in own) > 1:
                out.append((k, "covered", a, b))
            if i + 1 < len(runs):
                out.append((k, "gap", b + 1, runs[i + 1][0] - 1))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).withColumnRenamed("kind", "_lo")
    return sorted((tuple(r) for r in periods_and_gaps(df, ["k"], "lo", "hi", **kw).collect()), key=str)


interval = st.tuples(st.sampled_from(["a", "b", None]), st.integers(-30, 60) | st.none(), st.integers(-30, 60))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(interval, max_size=25), st.sampled_from([4, 16, 1 << 17]), st.sampled_from([1, 3]))
def test_random(spark, rows, block, salts):
    assert run(spark, rows, block=block, salts=salts) == brute(rows)
    assert run(spark, rows, block=block, salts=salts, only_merged=True) == brute(rows, True)


def test_long_interval_over_many_blocks(spark):
    rows = [("a", 1, 100), ("a", 10, 12), ("a", 50, 60), ("a", 101, 102), ("a", 110, 111), ("a", 113, 120), ("a", 113, 120)]
    assert run(spark, rows, block=8) == brute(rows)


def test_fixture_values(spark):
    assert run(spark, [("a", 1, 10), ("a", 5, 20), ("a", 30, 40)]) == [("a", "covered", 1, 20), ("a", "covered", 30, 40), ("a", "gap", 21, 29)]
    assert run(spark, [("a", 10, 20), ("a", 30, 21)]) == [("a", "covered", 10, 30)]


def test_empty_and_names(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert stretches(df, ["k"], "lo", "hi").collect() == []
    with pytest.raises(ValueError):
        stretches(df, ["k", "lo"], "lo", "hi")
    with pytest.raises(ValueError):
        stretches(df, ["nope"], "lo", "hi")


def test_far_positions(spark):
    far = 1 << 40
    df = spark.createDataFrame([("a", far, far + 5), ("a", far + 6, far + 9), ("a", 1, 2)], "k string, lo bigint, hi bigint")
    got = sorted(tuple(r) for r in periods_and_gaps(df, ["k"], "lo", "hi").collect())
    assert got == [("a", "covered", 1, 2), ("a", "covered", far, far + 9), ("a", "gap", 3, far - 1)]
