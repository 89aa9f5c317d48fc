"""The best row of each key, the first k, ranks, and duplicates of which the first stays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainspark.columns import free, q


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, *, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key in ``order``, which must decide every tie.

    Catalyst keeps only k rows a key in each task before the shuffle. ``rank`` names a column for the place.
    A null key is a key; an empty table gives none.
    """
    name = rank or free(df.columns, "_rank")
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*[q(x) for x in keys]).orderBy(*order))).where(F.col(q(name)) <= k)
    return out if rank else out.drop(name)


def best_fields(df: DataFrame, keys: Sequence[str], by: Column, fields: Sequence[str]) -> DataFrame:
    """One row per key with the ``fields`` of the row that has the greatest ``by`` (a struct, so that ties are
    decided): an aggregation with partial results, without sorting."""
    best = F.max_by(F.struct(*[F.col(q(f)) for f in fields]), by).alias("_best")
    return df.groupBy(*[q(x) for x in keys]).agg(best).select(*[q(x) for x in keys], "_best.*")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows without later ones of the same key, in ``order``: a deterministic drop of duplicates."""
    return best_per_key(df, keys, order)


def latest_records(df: DataFrame, record: str, version: str) -> DataFrame:
    """Each record once, as it was loaded last; rows with a null id stay, each its own record.

    One scan: rows without an id are spread over the tasks by their hash and pass the window untouched.
    """
    row = F.xxhash64(*[F.col(q(c)) for c, t in df.dtypes if not t.startswith("map")])
    place, salt = free(df.columns, "_place"), free(df.columns, "_salt")
    key = F.col(q(record))
    marked = df.withColumn(salt, F.when(key.isNull(), F.pmod(row, F.lit(4096))).otherwise(F.lit(0)))
    first = Window.partitionBy(q(record), salt).orderBy(F.col(q(version)).desc_nulls_last(), row)
    return marked.withColumn(place, F.row_number().over(first)).where(key.isNull() | (F.col(place) == 1)).drop(place, salt)


def preferred(df: DataFrame, group: Sequence[str], order: Sequence[Column], measure: str, *, top: int, within: float, forced: Column) -> DataFrame:
    """A shortlist of each group: of its first ``top`` rows those whose ``measure`` is at most ``within`` below
    the group's best, and any row that is ``forced``. Adds ``place``."""
    w = Window.partitionBy(*[q(x) for x in group])
    best, place = F.max(q(measure)).over(w), F.row_number().over(w.orderBy(*order))
    marked = df.withColumn("place", place).withColumn("_best", best)
    return marked.where(((F.col("place") <= top) & (F.col(q(measure)) >= F.col("_best") - within)) | forced).drop("_best")
