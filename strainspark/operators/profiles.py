"""Profiles of alleles: exact and wildcard lookup, nearest profile, scheme scores. Tables are long: one allele a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainspark.columns import q


def allele_rank(allele: Column) -> Column:
    """Order of alleles: numbers by value, then other text, empty last."""
    n = allele.try_cast("bigint")
    return F.struct(F.when(n.isNotNull(), 0).when(F.length(allele) > 0, 1).otherwise(2).alias("kind"), F.coalesce(n, F.lit(0)).alias("n"), F.coalesce(allele, F.lit("")).alias("text"))


def allele_notation(allele: Column, identity: Column, coverage: Column) -> Column:
    """n for an exact allele, ~n full-length but inexact, n? partial, - absent."""
    return F.when(allele.isNull(), "-").when((identity >= 100) & (coverage >= 100), allele).when(coverage >= 100, F.concat(F.lit("~"), allele)).otherwise(F.concat(allele, F.lit("?")))


def profile(df: DataFrame, keys: Sequence[str], locus: str, allele: str) -> DataFrame:
    """``keys`` and ``profile``: 'locus(allele) ...' in the order of loci (a locus has one allele; the lowest if not)."""
    one = df.groupBy(*[q(k) for k in keys], q(locus)).agg(F.min(q(allele)).alias("_a"))
    parts = F.sort_array(F.collect_list(F.struct(F.col(q(locus)).alias("l"), F.col("_a").alias("a"))))
    text = F.array_join(F.transform(parts, lambda x: F.concat(x.l, F.lit("("), x.a.cast("string"), F.lit(")"))), " ")
    return one.groupBy(*[q(k) for k in keys]).agg(text.alias("profile"))


def shared_loci(calls: DataFrame, profiles: DataFrame, sample: str, st: str, locus: str, allele: str) -> DataFrame:
    """``sample``, ``st``, ``n_shared``: loci at which a sample's call is the profile's allele. An equi join on locus and
    allele, counted before and after the shuffle; pairs that share nothing don't arise."""
    c = calls.where(F.col(q(allele)).isNotNull()).select(q(sample), q(locus), q(allele)).distinct()
    p = profiles.select(q(st), q(locus), q(allele)).distinct()
    return c.join(p, [locus, allele]).groupBy(q(sample), q(st)).agg(F.count(F.lit(1)).alias("n_shared"))


def lookup(calls: DataFrame, profiles: DataFrame, sample: str, st: str, locus: str, allele: str, *, missing: int = 0) -> DataFrame:
    """``sample``, ``st``, ``rivals``: the profile that agrees at all loci of the sample but for at most ``missing`` that
    it has no call for; of several the lowest, and all others (in order, by comma) as rivals.

    Null ``st`` where none does. A call that differs, or of a locus that the profile lacks, rules a profile out. A
    locus has one call and one allele: of several the lowest counts. Without ``missing`` loci a sample's calls are
    the whole profile, so both are brought together by a hash of their ordered pairs, whatever the number of
    samples that share an allele; else pairs that share alleles are counted (:func:`shared_loci`).
    """

    def one(df: DataFrame, key: str) -> DataFrame:
        return df.where(F.col(q(allele)).isNotNull()).groupBy(q(key), q(locus)).agg(F.min(q(allele)).alias(allele))

    c, p = one(calls, sample), one(profiles, st)
    if missing == 0:

        def whole(df: DataFrame, key: str, out: str) -> DataFrame:
            w = df.groupBy(q(key)).agg(F.sort_array(F.collect_list(F.struct(F.col(q(locus)).alias("l"), F.col(q(allele)).alias("a")))).alias(out))
            return w.withColumn(out + "_h", F.xxhash64(out))

        a, b = whole(c, sample, "_c"), whole(p, st, "_p")
        fit = a.join(b, (F.col("_c_h") == F.col("_p_h")) & (F.col("_c") == F.col("_p"))).select(q(sample), q(st))
    else:
        n_loci = p.groupBy(q(st)).agg(F.count(F.lit(1)).alias("_loci"))
        n_calls = c.groupBy(q(sample)).agg(F.count(F.lit(1)).alias("_calls"))
        met = shared_loci(c, p, sample, st, locus, allele).join(n_loci, st).join(n_calls, sample)
        fit = met.where((F.col("n_shared") == F.col("_calls")) & (F.col("_loci") - F.col("n_shared") <= missing))
    sts = fit.groupBy(q(sample)).agg(F.sort_array(F.collect_list(q(st))).alias("_s"))
    others = F.array_join(F.transform(F.slice("_s", F.lit(2), F.size("_s")), lambda x: x.cast("string")), ", ")
    return calls.select(q(sample)).distinct().join(sts, sample, "left").select(q(sample), F.get("_s", F.lit(0)).alias("st"), F.when(F.size("_s") > 1, others).otherwise("").alias("rivals"))


def nearest(calls: DataFrame, profiles: DataFrame, sample: str, st: str, locus: str, allele: str, *, lineage: str | None = None, differ: int = 1) -> DataFrame:
    """``sample``, ``st``, ``n_shared`` (and ``lineage``): the profiles that share the most loci with each sample, if they
    differ at no more than ``differ``; a lineage only where all of these name the same one."""
    n_loci = profiles.groupBy(q(st)).agg(F.count_distinct(q(locus)).alias("_loci"), *([F.first(q(lineage), True).alias("_lin")] if lineage else []))
    met = shared_loci(calls, profiles, sample, st, locus, allele).join(n_loci, st)
    place = F.rank().over(Window.partitionBy(q(sample)).orderBy(F.desc("n_shared")))
    top = met.withColumn("_r", place).where((F.col("_r") == 1) & (F.col("n_shared") >= F.col("_loci") - differ))
    agg = [F.min(q(st)).alias("st"), F.max("n_shared").alias("n_shared"), F.count(F.lit(1)).alias("n_equal")]
    if lineage:
        agg.append(F.when(F.count_distinct("_lin") == 1, F.min("_lin")).alias("lineage"))
    return top.groupBy(q(sample)).agg(*agg)


def scheme_scores(best: DataFrame, loci: DataFrame, group: Sequence[str], scheme: str, locus: str, identity: str, coverage: str) -> DataFrame:
    """Per group and scheme: loci found, exact, full-length, mean identity, distance to the scheme's number of loci,
    ``accepted`` (exact at half of the loci, at least 2) and ``place`` among the group's schemes."""
    total = loci.groupBy(q(scheme)).agg(F.count_distinct(q(locus)).alias("n_loci"))
    full, same = F.col(q(coverage)) >= 100, F.col(q(identity)) >= 100
    s = best.groupBy(*[q(g) for g in group], q(scheme)).agg(F.count(F.lit(1)).alias("n_found"), F.count_if(full & same).alias("n_exact"), F.count_if(full).alias("n_full"), F.avg(q(identity)).alias("mean_identity"))
    s = s.join(total, scheme).withColumn("missing", F.abs(F.col("n_loci") - F.col("n_found")))
    s = s.withColumn("accepted", F.col("n_exact") >= F.greatest(F.lit(2), F.floor(F.col("n_loci") / 2)))
    w = Window.partitionBy(*[q(g) for g in group]).orderBy(F.desc("n_exact"), F.desc("n_full"), F.desc("mean_identity"), "missing", q(scheme))
    return s.withColumn("place", F.row_number().over(w))
