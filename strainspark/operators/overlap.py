"""Overlapping intervals: greedy suppression, one primary of each locus, pairs that overlap, best cover of a point."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strainspark.columns import q, require
from strainspark.operators.folds import Fold, fold_groups


def islands(df: DataFrame, keys: Sequence[str], lo: str, hi: str, *, gap: int = 0, out: str = "island") -> DataFrame:
    """``df`` with the number of each row's run of intervals: a new one begins where ``lo`` lies more than ``gap``
    behind the furthest ``hi`` before it (of all earlier rows, not of the last one)."""
    w = Window.partitionBy(*[q(k) for k in keys]).orderBy(q(lo), q(hi))
    before = F.max(q(hi)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col(q(lo)) - before > gap, F.lit(True))
    marked = df.withColumn("_new", new)
    return marked.withColumn(out, F.count_if("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


class _Greedy(Fold):
    """Rows (keys, island, lo, hi, id) by falling rank; kept spans are sorted by start."""

    def __init__(self, fraction: float, at: int):
        self.fraction, self.at = fraction, at
        self.kept: list[tuple[int, int]] = []
        self.longest = 0

    def add(self, row):
        lo, hi, row_id = row[self.at], row[self.at + 1], row[self.at + 2]
        length = max(1, hi - lo + 1)
        i = bisect_left(self.kept, (lo - self.longest, -1))
        while i < len(self.kept) and self.kept[i][0] <= hi:
            a, b = self.kept[i]
            if max(0, min(hi, b) - max(lo, a) + 1) >= self.fraction * length:
                return ()
            i += 1
        insort(self.kept, (lo, hi))
        self.longest = max(self.longest, hi - lo + 1)
        return ((row_id,),)


def greedy_dedup(df: DataFrame, keys: Sequence[str], lo: str, hi: str, row_id: str, order: Sequence[Column], *, fraction: float = 0.5) -> DataFrame:
    """Rows in ``order`` (best first), but not one that overlaps a kept row of its group by at least ``fraction``
    of its own length (so with 1.0 a contained one still goes).

    Only rows of one run of overlapping intervals meet, each run on its own; the state is what was kept.
    ``row_id`` is unique and decides ties last; rows with a null id, lo or hi are left out. lo > hi is an empty
    interval of length 1 that overlaps nothing.
    """
    require(df, *keys, lo, hi, row_id)
    rows = df.where(F.col(q(lo)).isNotNull() & F.col(q(hi)).isNotNull() & F.col(q(row_id)).isNotNull())
    n = len(keys)
    ranks = [c.alias(f"_o{i}") for i, c in enumerate(_plain(order))]
    flat = rows.select(*[F.col(q(k)).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(q(lo)).cast("bigint").alias("_lo"), F.col(q(hi)).cast("bigint").alias("_hi"), F.col(q(row_id)).alias("_id"), *ranks)
    runs = islands(flat, [f"_k{i}" for i in range(n)], "_lo", "_hi", out="_run")
    ordered = [F.col(f"_o{i}").asc_nulls_last() if up else F.col(f"_o{i}").desc_nulls_last() for i, up in enumerate(_ascending(order))]
    runs = runs.select(*[f"_k{i}" for i in range(n)], "_run", "_lo", "_hi", "_id", *[f"_o{i}" for i in range(len(order))])
    kept = fold_groups(runs, n + 1, [*ordered, F.col("_id")], lambda: _Greedy(fraction, n + 1), T.StructType([T.StructField("_kept", df.schema[row_id].dataType)]))
    return rows.join(kept, F.col(q(row_id)) == F.col("_kept"), "left_semi")


def _plain(order: Sequence) -> list[Column]:
    return [c for c, _ in order]


def _ascending(order: Sequence) -> list[bool]:
    return [way == "asc" for _, way in order]


class _Locus(Fold):
    """Rows (keys, run, lo, hi, id, rank...) by start and end: the id of each row that loses its place."""

    def __init__(self, share: float, at: int):
        self.share, self.at = share, at
        self.claimed: list[list] = []  # in order of their claim: lo, hi, id, rank

    def add(self, row):
        lo, hi, row_id, rank = row[self.at], row[self.at + 1], row[self.at + 2], row[self.at + 3 :]
        length = max(1, hi - lo + 1)
        self.claimed = [c for c in self.claimed if c[1] >= lo]
        for place in self.claimed:
            shared = min(place[1], hi) - max(place[0], lo) + 1
            if shared >= self.share * min(length, max(1, place[1] - place[0] + 1)):
                if rank > place[3]:
                    loser, place[:] = place[2], [lo, hi, row_id, rank]
                    return ((loser,),)
                return ((row_id,),)
        self.claimed.append([lo, hi, row_id, rank])
        return ()


def locus_primary(df: DataFrame, keys: Sequence[str], lo: str, hi: str, row_id: str, rank: Sequence[Column], *, share: float = 0.6, out: str = "is_primary") -> DataFrame:
    """``df`` with ``out``: false for rows that describe a place which a better row of their group claims.

    Rows are read by start and end. A row that shares at least ``share`` of the shorter of the two with a
    claimed place contests the first such place; if its ``rank`` (numbers, the higher the better) is strictly
    greater it takes the place with its own span, else it loses. A null in ``rank`` counts as 0; rows with a
    null end are primary. ``row_id`` is unique.
    """
    require(df, *keys, lo, hi, row_id)
    n = len(keys)
    a, b = F.col(q(lo)).cast("bigint"), F.col(q(hi)).cast("bigint")
    ranks = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_r{i}") for i, c in enumerate(rank)]
    flat = df.where(a.isNotNull() & b.isNotNull()).select(*[F.col(q(k)).alias(f"_k{i}") for i, k in enumerate(keys)], F.least(a, b).alias("_lo"), F.greatest(a, b).alias("_hi"), F.col(q(row_id)).alias("_id"), *ranks)
    runs = islands(flat, [f"_k{i}" for i in range(n)], "_lo", "_hi", out="_run")
    runs = runs.select(*[f"_k{i}" for i in range(n)], "_run", "_lo", "_hi", "_id", *[f"_r{i}" for i in range(len(rank))])
    lost = fold_groups(runs, n + 1, [F.col("_lo"), F.col("_hi"), F.col("_id")], lambda: _Locus(share, n + 1), T.StructType([T.StructField("_lost", df.schema[row_id].dataType)]))
    return df.join(lost, F.col(q(row_id)) == F.col("_lost"), "left").withColumn(out, F.col("_lost").isNull()).drop("_lost")


def overlap_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], lo: str, hi: str, *, width: int, prefix: tuple[str, str] = ("a_", "b_")) -> DataFrame:
    """Pairs of a row of ``a`` and one of ``b`` with equal keys whose intervals share a position: all columns of
    both with their prefix.

    A range join on blocks of ``width`` positions: each interval is listed in the blocks that it touches,
    blocks are joined by equality, and the pair is put out in the block where the overlap begins, once.
    A hot key is thus split by position. Null keys and ends match nothing.
    """

    def blocks(df: DataFrame, p: str) -> DataFrame:
        named = df.select(*[F.col(q(c)).alias(p + c) for c in df.columns])
        return named.withColumn(p + "_block", F.explode(F.sequence(F.floor(F.col(q(p + lo)) / width), F.floor(F.col(q(p + hi)) / width))))

    pa_, pb = prefix
    x, y = blocks(a.where(F.col(q(lo)) <= F.col(q(hi))), pa_), blocks(b.where(F.col(q(lo)) <= F.col(q(hi))), pb)
    on = [F.col(q(pa_ + k)) == F.col(q(pb + k)) for k in keys] + [F.col(q(pa_ + "_block")) == F.col(q(pb + "_block"))]
    start = F.greatest(F.col(q(pa_ + lo)), F.col(q(pb + lo)))
    meets = (start <= F.least(F.col(q(pa_ + hi)), F.col(q(pb + hi)))) & (F.floor(start / width) == F.col(q(pa_ + "_block")))
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return x.join(y, cond & meets).drop(pa_ + "_block", pb + "_block")


def best_cover(points: DataFrame, spans: DataFrame, keys: Sequence[str], point: str, point_id: str, lo: str, hi: str, order: Sequence[Column], *, fields: Sequence[str]) -> DataFrame:
    """For each point the first span in ``order`` that holds it (equal keys, lo <= point <= hi): the points' columns
    and ``fields`` of the span. Points that none holds are left out. An equi join with the range as residual."""
    s = spans.select(*[F.col(q(k)).alias(f"_s{i}") for i, k in enumerate(keys)], F.col(q(lo)).alias("_lo"), F.col(q(hi)).alias("_hi"), *[F.col(q(f)) for f in fields])
    cond = F.col(q(point)).between(F.col("_lo"), F.col("_hi"))
    for i, k in enumerate(keys):
        cond = cond & (F.col(q(k)) == F.col(f"_s{i}"))
    met = points.join(s, cond)
    first = met.withColumn("_n", F.row_number().over(Window.partitionBy(q(point_id)).orderBy(*order))).where("_n = 1")
    return first.select(*[F.col(q(c)) for c in points.columns], *[F.col(q(f)) for f in fields])


class _OneToOne(Fold):
    """Candidate pairs (keys, a, b) in order: a pair is taken if neither side is."""

    def __init__(self, at: int):
        self.at, self.a, self.b = at, set(), set()

    def add(self, row):
        a, b = row[self.at], row[self.at + 1]
        if a in self.a or b in self.b:
            return ()
        self.a.add(a)
        self.b.add(b)
        return ((a, b),)


def match_one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str], lo: str, hi: str, row_id: str, *, share: float = 0.5, width: int) -> DataFrame:
    """``a_id``, ``b_id``: rows of ``a``, by start and id, each with the first free row of ``b`` (by start and id) of its
    keys that overlaps it by at least ``share`` of the shorter of the two.

    Candidates come from :func:`overlap_pairs`; a group's candidates stream through one task, which holds the
    ids matched so far. Ids are of one type and unique on each side.
    """
    p = overlap_pairs(a, b, keys, lo, hi, width=width)
    A, B = (lambda c: F.col(q("a_" + c))), (lambda c: F.col(q("b_" + c)))
    shared = F.least(A(hi), B(hi)) - F.greatest(A(lo), B(lo)) + 1
    p = p.where(shared >= share * F.least(A(hi) - A(lo) + 1, B(hi) - B(lo) + 1))
    flat = p.select(*[A(k).alias(f"_k{i}") for i, k in enumerate(keys)], A(row_id).alias("_a"), B(row_id).alias("_b"), A(lo).alias("_al"), B(lo).alias("_bl"))
    kind = a.schema[row_id].dataType
    out = T.StructType([T.StructField("a_id", kind), T.StructField("b_id", kind)])
    n = len(keys)
    return fold_groups(flat, n, [F.col("_al"), F.col("_a"), F.col("_bl"), F.col("_b")], lambda: _OneToOne(n), out)
