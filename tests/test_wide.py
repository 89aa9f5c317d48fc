"""Wide tables: types, cast failures, disagreements, and the odd cases."""

import pytest

from strainspark.operators.wide import attributes, cells, column_names, narrow, widen

ROWS = [("s1", "a", "1.5", 1), ("s1", "a", "2.5", 2), ("s1", "b", "x", 1), ("s2", "a", "3", 1), ("s2", "a", "3", 1), ("s2", "c", None, 1), (None, "a", "1", 1), ("s3", None, "1", 1), ("s4", "z", "9", 1)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "e string, k string, v string, t int")


def test_values(spark):
    got = {r["e"]: r for r in widen(frame(spark), "e", "k", "v", keys=["a", "b", "c"], types="double").collect()}
    assert set(got) == {"s1", "s2"}
    assert got["s1"]["a"] == 2.5 and got["s1"]["b"] is None and got["s1"]["cast_failures"] == {"b": "x"} and got["s1"]["disagreements"] == ["a"]
    assert got["s2"]["a"] == 3.0 and got["s2"]["c"] is None and got["s2"]["cast_failures"] == {} and got["s2"]["disagreements"] == []


def test_order_and_types(spark):
    rows = [("s", "n", "7", 2), ("s", "n", "9", 1), ("s", "d", "2024-01-02", 1), ("s", "t", "word", 1), ("s", "bad", "2024-99-99", 1)]
    r = widen(frame(spark, rows), "e", "k", "v", types={"n": "int", "d": "date", "bad": "date"}, order="t").first()
    assert r["n"] == 7 and str(r["d"]) == "2024-01-02" and r["t"] == "word" and r["bad"] is None and r["cast_failures"] == {"bad": "2024-99-99"}


def test_found_keys_and_clashes(spark):
    assert attributes(frame(spark), "k") == ["a", "b", "c", "z"]
    with pytest.raises(ValueError):
        attributes(frame(spark), "k", most=2)
    with pytest.raises(ValueError):
        widen(frame(spark), "e", "k", "v", keys=["a", "A"])
    with pytest.raises(ValueError):
        widen(frame(spark), "e", "k", "v", keys=["E"])


def test_empty(spark):
    df = widen(frame(spark, []), "e", "k", "v", keys=["a"])
    assert df.columns == ["e", "a", "cast_failures", "disagreements"] and df.collect() == []
    assert widen(frame(spark, []), "e", "k", "v").collect() == []


def test_names_that_clash(spark):
    rows = [("s", "a", "1", 1), ("s", "A", "2", 1), ("s", "E", "3", 1), ("s", "disagreements", "4", 1), ("s", "x' y\"`", "5", 1)]
    names = column_names(attributes(frame(spark, rows), "k"), "e")
    wide = widen(frame(spark, rows), "e", "k", "v", keys=list(names), names=names)
    assert len({c.lower() for c in wide.columns}) == 8 and names["A"] == "A" and names["a"] == "a_"
    assert {r["attribute"]: r["value"] for r in narrow(wide, "e", names).collect()} == {"a": 1.0, "A": 2.0, "E": 3.0, "disagreements": 4.0, "x' y\"`": 5.0}
    assert narrow(wide, "e", {}).collect() == []


def test_beyond_the_most_columns_cells_give_the_long_form(spark):
    rows = [("s", f"k{i}", str(i), 1) for i in range(30)]
    with pytest.raises(ValueError):
        widen(frame(spark, rows), "e", "k", "v", most=20)
    assert {(r["attribute"], r["value"]) for r in cells(frame(spark, rows), "e", "k", "v").collect()} == {(k, v) for _, k, v, _ in rows}


def test_primes_stay_apart(spark):
    rows = [("s", "aac(3')", "1", 1), ("s", "aac(3'')", "2", 1)]
    r = widen(frame(spark, rows), "e", "k", "v").first()
    assert r["aac(3')"] == 1.0 and r["aac(3'')"] == 2.0 and r["disagreements"] == []
