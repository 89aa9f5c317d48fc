"""Rates, copies and shares."""

import math

import pytest

from strainspark.llm.mixing import Mix, with_tokens

DOCS = [(i, ["A", " a ", "b", "B", "rare", None, "untargeted", " "][i % 8], "one two three four " * (1 + i % 3)) for i in range(400)] + [(1000, "a", None), (1001, "b", "")]
TARGETS = [("a", 0.5, 1), ("B ", 0.2, 3), ("b", 0.1, 2), ("rare", 0.15, 9), ("gone", 0.05, 4), (None, 0.1, 1), ("gone", 0.05, 4)]


def mix(spark, docs=DOCS):
    return Mix(spark.createDataFrame(docs, "doc_id bigint, source string, text string"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int"))


def test_rates_and_copies(spark):
    m = mix(spark)
    rates = {r["key"]: r for r in m.rates.collect()}
    tokens = {k: sum(r["n_tokens"] for r in m.sized.where(f"key = '{k}'").collect()) for k in ("a", "b", "rare")}
    assert m.total == sum(r["n_tokens"] for r in m.sized.collect())
    assert rates["a"]["rate"] == min(1, 0.5 * m.total / tokens["a"]) and rates["b"]["target_share"] == pytest.approx(0.3) and rates["b"]["cap"] == 3
    assert rates["gone"]["rate"] == 0 and {r["key"] for r in m.short().collect()} == {"gone", "rare", "a"} & {k for k, r in rates.items() if r["want"] > r["cap"] * r["tokens"]} and set(rates) == {"a", "b", "rare", "gone"}
    n = {r["id"]: (r["key"], r["n"]) for r in m.copies().collect()}
    assert all(math.floor(rates[k]["rate"]) <= c <= math.ceil(rates[k]["rate"]) for k, c in n.values())
    assert n == {r["id"]: (r["key"], r["n"]) for r in m.copies().collect()}
    out = m.documents()
    assert out.columns == ["doc_id", "source", "n_tokens", "copy"] and out.count() == sum(c for _, c in n.values())


def test_shares(spark):
    s = {r["source"]: r for r in mix(spark).shares().collect()}
    assert sum(r["share"] for r in s.values()) == pytest.approx(1) and s["gone"]["n_tokens"] == 0
    assert 0 < s["B "]["rate"] <= 3 and abs(s["B "]["n_documents"] / 102 - s["B "]["rate"]) < 0.2


def test_empty(spark):
    m = mix(spark, [])
    assert m.total == 0 and m.documents().collect() == [] and all(r["share"] is None and r["rate"] == 0 for r in m.shares().collect())


def test_tokens(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",), ("word " * 40000,)], "t string")
    got = [r["n_tokens"] for r in with_tokens(df, "t").collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 1 and 40000 <= got[4] <= 40002
    with pytest.raises(ValueError):
        with_tokens(df.withColumnRenamed("t", "n_tokens"), "n_tokens")


def test_long_texts_have_the_tokens_of_the_whole(spark):
    """Without white space, with tabs only, with a word over many thousand characters: as encoded in one go."""
    from strainspark.llm.mixing import RANKS, TOKENIZERS, _encoding

    texts = ["abcdefg" * 20000, "word\t" * 30000, " ".join(["ab"] * 50000), "x" * 70000 + " " + "y" * 70000]
    got = {r["t"]: r["n_tokens"] for r in with_tokens(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}
    whole = _encoding(f"{TOKENIZERS}/{RANKS}")
    assert [got[t] for t in texts] == [len(whole.encode_ordinary(t)) for t in texts] and got[texts[0]] == 60000


def test_many_targets_are_joined_by_a_shuffle(spark, monkeypatch):
    from strainspark.llm import mixing

    want = sorted(map(tuple, mix(spark).documents().collect()))
    monkeypatch.setattr(mixing, "FEW", 0)
    assert sorted(map(tuple, mix(spark).documents().collect())) == want and want


def test_sizes_that_are_given(spark):
    docs = spark.createDataFrame([(1, "a", 10, None), (2, "a", None, None), (3, "b", -5, None), (4, "b", 30, None)], "doc_id bigint, source string, n int, text string")
    targets = spark.createDataFrame([("a", 0.75, 2), ("b", 0.25, 1), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    m = Mix(docs, targets, size="n")
    assert m.total == 40 and [r["source"] for r in m.short().collect()] == ["a"]
    assert sorted((r["doc_id"], r["copy"]) for r in m.documents().where("source = 'a'").collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]
