"""The pair table after random batches against counting from scratch."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from strainspark.llm.pairs import PairTable, pair_deltas
from strainspark.session import scratch


def brute(state):
    items, pairs = {}, {}
    for members in state.values():
        for x in members:
            items[x] = items.get(x, 0) + 1
        for p in combinations(sorted(members), 2):
            pairs[p] = pairs.get(p, 0) + 1
    return items, pairs


def check(table, state):
    items, pairs = brute(state)
    assert {r["item"]: r["n"] for r in table.items().collect()} == items
    total = sum(bool(m) for m in state.values())
    assert table.total == total
    got = {(r["a"], r["b"]): (r["n"], r["n_a"], r["n_b"], r["lift"]) for r in table.scores().collect()}
    assert got == {(a, b): (n, items[a], items[b], n * total / (items[a] * items[b])) for (a, b), n in pairs.items()}


def test_batches(spark):
    rng = random.Random(7)
    table, state = PairTable(spark, scratch(spark, "t"), buckets=4), {}
    for step, replace in enumerate((False, False, True)):
        change = {}
        for _ in range(8):
            change[f"b{rng.randrange(9)}"] = {f"i{rng.randrange(7)}" for _ in range(rng.randrange(0, 6))}
        rows = [(b, i, "extra") for b, m in change.items() for i in m] + [(None, "i1", ""), ("b1", None, "")] + [(b, None, "") for b in change]
        rows += rows[:3]
        if replace:
            change.setdefault("b1", set())
        for b, m in change.items():
            state[b] = m if replace else state.get(b, set()) | m
        table.apply(spark.createDataFrame(rows, "basket string, item string, S string"), "basket", "item", replace=replace)
        check(table, state)
    table.vacuum()
    again = PairTable(spark, table.path)
    check(again, state)
    assert again.manifest["batch"] == 3


def test_affected(spark):
    table = PairTable(spark, scratch(spark, "t"), buckets=4)
    table.apply(spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c"), ("2", "d")], "k string, v string"), "k", "v")
    table.apply(spark.createDataFrame([("3", "a"), ("3", "x")], "k string, v string"), "k", "v")
    assert {(r["a"], r["b"]) for r in table.affected().collect()} == {("a", "b"), ("a", "x")}


def test_empty(spark):
    table = PairTable(spark, scratch(spark, "t"))
    table.apply(spark.createDataFrame([], "k string, v string"), "k", "v")
    assert table.total == 0 and table.scores().collect() == []
    table.apply(spark.createDataFrame([("1", "a")], "k string, v string"), "k", "v")
    assert table.total == 1 and table.scores().collect() == [] and table.items().count() == 1


def test_large_basket_in_blocks(spark):
    n = 70
    rows = spark.range(n).select(F.lit("b").alias("basket"), F.format_string("i%02d", "id").alias("item"), F.lit(1).alias("s"))
    got = pair_deltas(rows, block=8)
    assert got.count() == n * (n - 1) // 2 and got.where("d <> 1 OR a >= b").count() == 0


def test_a_failed_batch_changes_nothing_and_can_be_given_again(spark, monkeypatch):
    import pytest

    table = PairTable(spark, scratch(spark, "t"), buckets=2)
    table.apply(spark.createDataFrame([("1", "a"), ("1", "b")], "k string, v string"), "k", "v")
    more = spark.createDataFrame([("2", "a"), ("2", "b"), ("3", "c")], "k string, v string")

    def fail(*a):
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr(PairTable, "_save", fail)
        with pytest.raises(OSError):
            table.apply(more, "k", "v")
    check(table, {"1": {"a", "b"}})
    other = PairTable(spark, table.path)
    table.apply(more, "k", "v")
    check(table, {"1": {"a", "b"}, "2": {"a", "b"}, "3": {"c"}})
    with pytest.raises(RuntimeError):
        other.apply(spark.createDataFrame([("9", "z")], "k string, v string"), "k", "v")
    check(PairTable(spark, table.path), {"1": {"a", "b"}, "2": {"a", "b"}, "3": {"c"}})


def test_buckets_grow(spark):
    table, state = PairTable(spark, scratch(spark, "t"), buckets=1, bucket_rows=8), {}
    for step in range(3):
        change = {f"b{step}{k}": {f"i{(step * 3 + k + j) % 17}" for j in range(6)} for k in range(6)}
        state |= change
        table.apply(spark.createDataFrame([(b, i) for b, m in change.items() for i in m], "k string, v string"), "k", "v")
    check(table, state)
    assert table.manifest["buckets"]["pairs"] > 1 and table.manifest["rows"]["pairs"] <= 2 * 8 * table.manifest["buckets"]["pairs"]
    table.vacuum()
    check(PairTable(spark, table.path), state)


def test_a_manifest_that_was_never_finished_is_no_table(spark):
    table = PairTable(spark, scratch(spark, "t"))
    fs, at = table._fs(f"{table.path}/manifest/1.tmp")
    fs.create(at, True).close()
    assert PairTable(spark, table.path).manifest["batch"] == 0
