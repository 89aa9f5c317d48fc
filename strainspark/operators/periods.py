"""Overlapping, touching and gapped intervals per entity: continuous stretches and the gaps between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strainspark.columns import q, require

#: Positions per block. Intervals are first merged inside the block that holds their first position.
BLOCK = 1 << 17
#: Parts into which each entity's block is split before its intervals first meet.
SALTS = 8


def _sessions(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """One round of session_window with a duration of its own for each row: positions are microseconds."""
    n = F.expr("make_interval(0, 0, 0, 0, 0, 0, CAST(_hi - _lo + 1 AS DECIMAL(18, 0)) * 0.000001BD)")
    return (
        df.groupBy(*by, F.session_window(F.timestamp_micros("_lo"), n).alias("_w"))
        .agg(F.max("_a").alias("_a"), F.min("_b").alias("_b"))
        .select(*by, F.unix_micros("_w.start").alias("_lo"), (F.unix_micros("_w.end") - 1).alias("_hi"), "_a", "_b")
    )


def stretches(df: DataFrame, keys: Sequence[str], lo: str, hi: str, *, block: int = BLOCK, salts: int = SALTS) -> DataFrame:
    """Continuous covered stretches of each entity, with the start of the next one.

    Intervals are 1-based whole numbers with both ends included; a reversed one covers the same
    positions; those that overlap, nest or touch (next lo = hi + 1) are one stretch. Result: ``keys``,
    ``lo`` and ``hi`` BIGINT, ``several`` BOOLEAN (made of at least two different intervals, copies
    count once) and ``next_lo`` BIGINT (null after the last stretch).

    Rows with a null end are left out. A null key is an entity like any other. Repeated rows change
    nothing, ties have no say, an empty table gives an empty result, other columns are not carried.
    A key named like a result column (``lo hi several next_lo kind``) raises ValueError.

    session_window merges what overlaps, first within (entity, block of positions, salt), then within
    (entity, block): a hot entity is spread over its blocks and salts and shrinks before its parts
    meet. Per entity only one row for each block (the furthest end) and at most three stretches of
    each block are then ordered in one place.
    """
    require(df, *keys, lo, hi)
    if clash := {k.lower() for k in keys} & {"lo", "hi", "several", "next_lo", "kind"}:
        raise ValueError(f"keys named like result columns: {sorted(clash)}")
    a, b = F.col(q(lo)).cast("bigint"), F.col(q(hi)).cast("bigint")
    names = [f"_k{i}" for i in range(len(keys))]
    at = [*names, "_block"]
    rows = (
        df.where(a.isNotNull() & b.isNotNull())
        .select(*[F.col(q(k)).alias(n) for k, n in zip(keys, names)], F.least(a, b).alias("_lo"), F.greatest(a, b).alias("_hi"))
        .withColumn("_block", F.floor(F.col("_lo") / F.lit(block)))
    )
    # _a and _b: the last start and the first end of a stretch, which are its own ends if it is one interval.
    salted = rows.select(*at, F.pmod(F.xxhash64("_lo", "_hi"), F.lit(salts)).alias("_salt"), "_lo", "_hi", F.col("_lo").alias("_a"), F.col("_hi").alias("_b"))
    local = _sessions(_sessions(salted, [*at, "_salt"]).drop("_salt"), at)

    # The furthest end that reaches a block from earlier ones: a row per block, so few for any entity.
    before = Window.partitionBy(*names).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*at).agg(F.max("_hi").alias("_hi")).select(*names, "_block", F.max("_hi").over(before).alias("_carry"))
    carry = carry.where("_carry IS NOT NULL").select(*[F.col(c).alias("r" + c) for c in at], "_carry")
    same = [F.col(c).eqNullSafe(F.col("r" + c)) for c in at]
    in_block = Window.partitionBy(*at).orderBy("_lo")
    parts = (
        local.join(carry, same, "left")
        .withColumn("_prev", F.lag("_hi").over(in_block))
        .withColumn("_start", F.coalesce(F.col("_lo") > F.greatest("_prev", "_carry") + 1, F.lit(True)))
        .withColumn("_c", F.count_if("_start").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*at, "_c")
        .agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_a").alias("_a"), F.min("_b").alias("_b"))
    )
    by_c = Window.partitionBy(*at).orderBy("_c")
    parts = parts.withColumn("_next", F.lead("_lo").over(by_c))
    closed = (F.col("_c") > 1) & F.col("_next").isNotNull()
    out = [*names, "_lo", "_hi", "_a", "_b", "_next"]

    # What may go on over a border of blocks: the first and last parts of each block.
    order = Window.partitionBy(*names).orderBy("_block", "_c")
    edges = (
        parts.where(~closed)
        .withColumn("_id", F.count_if(F.col("_c") > 0).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*names, "_id")
        .agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_a").alias("_a"), F.min("_b").alias("_b"), F.max_by("_next", F.struct("_block", "_c")).alias("_next"))
        .withColumn("_next", F.coalesce("_next", F.lead("_lo").over(Window.partitionBy(*names).orderBy("_id"))))
    )
    return (
        parts.where(closed).select(*out).unionByName(edges.select(*out))
        .select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), ((F.col("_a") != F.col("_lo")) | (F.col("_b") != F.col("_hi"))).alias("several"), F.col("_next").alias("next_lo"))
    )


def periods_and_gaps(df: DataFrame, keys: Sequence[str], lo: str, hi: str, *, only_merged: bool = False, block: int = BLOCK, salts: int = SALTS) -> DataFrame:
    """``keys``, ``kind`` ('covered' or 'gap'), ``lo``, ``hi``: the stretches of :func:`stretches` and the
    uncovered positions between neighbouring ones. ``only_merged`` leaves out stretches of a single interval;
    the gaps beside them stay."""
    s = stretches(df, keys, lo, hi, block=block, salts=salts)
    keep = F.col("several") if only_merged else F.lit(True)
    covered = F.when(keep, F.struct(F.lit("covered").alias("kind"), F.col("lo").alias("lo"), F.col("hi").alias("hi")))
    gap = F.when(F.col("next_lo").isNotNull(), F.struct(F.lit("gap").alias("kind"), (F.col("hi") + 1).alias("lo"), (F.col("next_lo") - 1).alias("hi")))
    return s.select(*[F.col(q(k)) for k in keys], F.inline(F.array_compact(F.array(covered, gap))))
