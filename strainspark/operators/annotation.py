"""Annotation carried over by key, filled by group, and prefix relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainspark.columns import q


def transfer(df: DataFrame, row_id: str, keys: str, known: DataFrame, known_key: str, fields: Sequence[str]) -> DataFrame:
    """``row_id`` and the ``fields`` that the first of the row's ``keys`` (an array, in order) has in ``known``.

    ``known_key`` should be unique (of several rows any one is taken, always the same); rows without a match are
    left out. An equi join; only the best match of a row is kept, before and after the shuffle.
    """
    at = df.select(q(row_id), F.posexplode(q(keys)).alias("_at", "_key"))
    k = known.select(F.col(q(known_key)).alias("_k"), F.struct(*[q(f) for f in fields]).alias("_f")).groupBy("_k").agg(F.min("_f").alias("_f"))
    met = at.join(k, F.col("_key") == F.col("_k"))
    return met.groupBy(q(row_id)).agg(F.min_by("_f", "_at").alias("_f")).select(q(row_id), "_f.*")


def unambiguous(df: DataFrame, group: str, value: str) -> DataFrame:
    """``group`` and its ``value`` where all rows (nulls apart) agree on one."""
    return df.where(F.col(q(value)).isNotNull() & F.col(q(group)).isNotNull()).groupBy(q(group)).agg(F.min(q(value)).alias("_lo"), F.max(q(value)).alias("_hi")).where("_lo = _hi").select(q(group), F.col("_lo").alias(value))


def fill_from_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """``df`` with null ``value``s filled from :func:`unambiguous` ones of the group."""
    u = unambiguous(df, group, value).withColumnRenamed(value, "_fill")
    return df.join(u, group, "left").withColumn(value, F.coalesce(q(value), "_fill")).drop("_fill").select(*[q(c) for c in df.columns])


def prefix_related(a: DataFrame, a_name: str, b: DataFrame, b_name: str, *, sep: str = "_") -> DataFrame:
    """Pairs of names of which one is the other or begins with it and ``sep``: all columns of both (names differ).

    Without a cross join: each name is listed with all its prefixes up to a ``sep``, so one of the two names
    is among the other's and an equi join finds the pair; a pair of equal names counts once.
    """

    def prefixes(c: str):
        parts = F.split(F.col(q(c)), sep)
        return F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), sep)))

    one = a.withColumn("_p", prefixes(a_name)).join(b, F.col("_p") == F.col(q(b_name))).drop("_p")
    two = b.withColumn("_p", prefixes(b_name)).where(F.col("_p") != F.col(q(b_name))).join(a, F.col("_p") == F.col(q(a_name))).drop("_p")
    return one.unionByName(two.select(*[q(c) for c in one.columns]))
