"""Pileup tokens to counts, consensus bases, allele fractions and calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainspark.columns import q
from strainspark.functions.stats import binomial_upper_tail

#: A token: a base, with what is inserted (+2GT) or deleted (-1N) behind it; '*' where a deletion covers the place.
_TOKEN = r"^([ACGTN*])(?:([+-])(\d+)([ACGTN]*))?$"


def token_base(token: Column) -> Column:
    return F.regexp_extract(token, _TOKEN, 1)


def base_counts(df: DataFrame, keys: Sequence[str], token: str) -> DataFrame:
    """Per key (a position): ``n_a n_c n_g n_t``, ``n_indel`` (tokens that insert, delete or are deleted), ``depth``
    (all tokens) and ``base``, the most frequent one, of equal ones the last by letter."""
    t = F.col(q(token))
    base = token_base(t)
    n = {b: F.count_if(base == b) for b in "ACGT"}
    top = F.greatest(*[F.struct(n[b].alias("n"), F.lit(b).alias("b")) for b in "ACGT"])
    indel = F.startswith(t, F.lit("*")) | (F.regexp_extract(t, _TOKEN, 2) != "")
    return df.groupBy(*[q(k) for k in keys]).agg(
        *[n[b].alias(f"n_{b.lower()}") for b in "ACGT"], F.count_if(indel).alias("n_indel"), F.count(t).alias("depth"), F.when(top["n"] > 0, top["b"]).alias("base")
    )


def consensus(df: DataFrame, keys: Sequence[str], position: str, base: str, depth: str, *, min_depth: int = 1, length: str | None = None) -> DataFrame:
    """Per key the bases in order of position as one string (N below ``min_depth`` or without a base), and how many
    were called. A key's positions are one reference's, so the array is as long as that reference.

    Without ``length`` places without a row are left out of the string. With it (a column, the reference's length,
    the same in all rows of a key) they are N, and the base of position p is the string's p-th; positions beyond
    the length (or all, if it is null) still count, positions below 1 don't.
    """
    called = F.when((F.col(q(depth)) >= min_depth) & F.col(q(base)).isNotNull(), F.col(q(base))).otherwise("N")
    if length:
        at = F.col(q(position))
        # collect_list drops nulls.
        there = F.map_from_entries(F.collect_list(F.when(at >= 1, F.struct(at.cast("int").alias("p"), called.alias("b")))))
        last = F.greatest(F.max(F.col(q(length))), F.max(at)).cast("int")
        n = df.groupBy(*[q(k) for k in keys]).agg(there.alias("_there"), last.alias("_last"), F.count_if((called != "N") & (at >= 1)).alias("n_called"))
        places = F.when(F.col("_last") >= 1, F.sequence(F.lit(1), F.greatest("_last", F.lit(1)))).otherwise(F.array().cast("array<int>"))
        full = F.array_join(F.transform(places, lambda i: F.coalesce(F.try_element_at("_there", i), F.lit("N"))), "")
        return n.select(*[q(k) for k in keys], full.alias("consensus"), "n_called")
    ordered = F.sort_array(F.collect_list(F.struct(F.col(q(position)).alias("p"), called.alias("b"))))
    return df.groupBy(*[q(k) for k in keys]).agg(F.array_join(F.transform(ordered, lambda x: x.b), "").alias("consensus"), F.count_if(called != "N").alias("n_called"))


def status(depth: Column, fraction: Column, *, min_depth: int = 20, least: float = 0.05, fixed: float = 0.9) -> Column:
    """A site's ladder: low-depth, fixed, heteroresistant, absent."""
    return F.when(depth < min_depth, "low-depth").when(fraction >= fixed, "fixed").when(fraction >= least, "heteroresistant").otherwise("absent")


def allele_fractions(df: DataFrame, keys: Sequence[str], is_alt: Column, *, error: float = 0.002, **thresholds: float) -> DataFrame:
    """Per key ``depth``, ``n_alt``, ``fraction``, ``p_value`` (of at least as many by error alone) and ``status``."""
    n = df.groupBy(*[q(k) for k in keys]).agg(F.count(F.lit(1)).cast("int").alias("depth"), F.count_if(is_alt).cast("int").alias("n_alt"))
    n = n.withColumn("fraction", F.col("n_alt") / F.col("depth"))
    return n.withColumn("p_value", binomial_upper_tail(F.col("n_alt"), F.col("depth"), error)).withColumn("status", status(F.col("depth"), F.col("fraction"), **thresholds))
