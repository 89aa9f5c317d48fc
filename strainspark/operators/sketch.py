"""MinHash sketches of sequences or texts and the distances between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainspark.columns import q


def kmers(text: Column, k: int) -> Column:
    """The distinct substrings of k characters (none for shorter texts)."""
    n = F.length(text) - k + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(k))))).otherwise(F.array().cast("array<string>"))


def sketches(df: DataFrame, key: str, text: str, *, k: int = 21, size: int = 1000, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``key``, ``h``: the ``size`` lowest distinct k-mer hashes of each key's rows, one a row.

    A row's own lowest hashes are taken first, so a key of many rows shrinks before the shuffle; rows of
    a key are pooled. ``hashed`` makes a BIGINT of a k-mer.
    """
    own = F.slice(F.array_sort(F.array_distinct(F.transform(kmers(F.col(q(text)), k), lambda x: hashed(x)))), 1, size)
    rows = df.where(F.col(q(key)).isNotNull()).select(F.col(q(key)).alias(key), F.explode(own).alias("h")).distinct()
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(q(key)).orderBy("h"))).where(F.col("_n") <= size).drop("_n")


def distances(a: DataFrame, b: DataFrame, key_a: str, key_b: str, *, k: int = 21, size: int = 1000) -> DataFrame:
    """Pairs of a sketch of ``a`` and one of ``b``: ``key_a``, ``key_b``, ``n_shared``, ``jaccard`` and ``distance``
    -ln(2j / (1 + j)) / k.

    The Jaccard index is estimated over the ``size`` lowest hashes of the union of the two sketches (all of them, if
    there are fewer): hashes beyond belong to neither count, so sets of different sizes compare alike. Pairs
    that share none of these aren't put out.
    """
    whole = lambda df, key, out: df.groupBy(q(key)).agg(F.sort_array(F.collect_list("h")).alias(out))  # of at most size hashes
    met = a.join(b, "h").select(q(key_a), q(key_b)).distinct().join(whole(a, key_a, "_a"), key_a).join(whole(b, key_b, "_b"), key_b)
    lowest = F.slice(F.array_sort(F.array_union("_a", "_b")), 1, size)
    met = met.withColumn("_u", lowest).withColumn("n_shared", F.size(F.array_intersect(F.array_intersect("_a", "_b"), "_u")).cast("bigint"))
    j = F.col("n_shared") / F.size("_u")
    return met.where("n_shared > 0").select(q(key_a), q(key_b), "n_shared", j.alias("jaccard"), F.greatest(F.lit(0.0), -F.log(2 * j / (1 + j)) / k).alias("distance"))


def nearest(pairs: DataFrame, key: str, reference: str, *, limit: float = 0.05) -> DataFrame:
    """Of each key the reference with the least distance (of equal ones the first by name), if it is at most ``limit``."""
    first = F.min(F.struct("distance", F.col(q(reference)).alias("r")))
    best = pairs.where(F.col("distance") <= limit).groupBy(q(key)).agg(first.alias("x"))
    return best.select(q(key), F.col("x.r").alias(reference), F.col("x.distance").alias("distance"))
