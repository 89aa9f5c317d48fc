"""Column functions of statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """Natural log of the gamma function for x of at least 1 (Lanczos approximation, 15 digits)."""
    z = x.cast("double") - 1
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + c / (z + i)
    t = z + 7.5
    return F.lit(0.9189385332046727) + (z + 0.5) * F.log(t) - t + F.log(total)


def binomial_upper_tail(k: Column, n: Column, p: float) -> Column:
    """P(X >= k) for a binomial X of n trials with probability p: the tail is summed upward, so that tiny
    values keep their digits. 1 for n or k of 0 or less, 0 for k over n; p at or beyond 0 and 1 likewise."""
    edge = F.when((n <= 0) | (k <= 0), 1.0).when(k > n, 0.0)
    if p <= 0 or p >= 1:
        return edge.otherwise(0.0 if p <= 0 else 1.0)
    odds = p / (1 - p)
    first = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    # Each term follows from the one before: P(i + 1) = P(i) (n - i) / (i + 1) odds, kept as its log.
    rest = F.when(k < n, F.sequence(k, n - 1)).otherwise(F.array().cast("array<int>"))

    def add(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log((n - i) / (i + 1) * odds)
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    added = F.aggregate(rest, F.struct(first.alias("log"), F.exp(first).alias("sum")), add, lambda acc: acc["sum"])
    return edge.otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), added)))


def match_score(coverage_pct: Column, identity_pct: Column) -> Column:
    return coverage_pct * identity_pct / 100.0
