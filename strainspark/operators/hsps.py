"""HSPs of one reference merged into hits, one for each copy on the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strainspark.columns import require
from strainspark.operators.folds import Fold, fold_groups

MERGED = (
    "qseqid string, sseqid string, strand string, slen int, qlen int, identity_pct double, coverage_pct double, covered_bases int, "
    "subject_intervals array<struct<lo:int,hi:int>>, query_start int, query_end int, gaps int, bitscore double, evalue double, n_hsps int"
)
COLUMNS = ["qseqid", "sseqid", "strand", "_copy", "slen", "qlen", "_s_lo", "_s_hi", "_q_lo", "_q_hi", "length", "nident", "gaps", "bitscore", "evalue", "hsp_id"]


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


class _Merge(Fold):
    """HSPs of one copy by falling score: those that add reference and fit the copy's extent are taken."""

    def __init__(self, scale: float, slack: int):
        self.scale, self.slack = scale, slack
        self.spans: list[tuple[int, int]] = []
        self.first = None
        self.matched = self.aligned = self.bits = 0.0
        self.gaps = 0

    def add(self, row):
        q, s, strand, _, slen, qlen, s_lo, s_hi, q_lo, q_hi, length, nident, gaps, bits, evalue, _ = row
        own = s_hi - s_lo + 1
        shared = [max(0, min(s_hi, b) - max(s_lo, a) + 1) for a, b in self.spans]
        if any(x > 0.5 * own for x in shared):
            return ()
        if self.first is None:
            self.first = (q, s, strand, slen, qlen)
            self.lo, self.hi, self.evalue = q_lo, q_hi, evalue
        elif max(q_hi, self.hi) - min(q_lo, self.lo) + 1 > int(slen * self.scale * 2) + self.slack:
            return ()
        # Identity counts by the share of the reference that is new.
        fresh = max(0, own - sum(shared)) / own
        self.matched, self.aligned = self.matched + nident * fresh, self.aligned + length * fresh
        self.spans.append((s_lo, s_hi))
        self.lo, self.hi, self.evalue = min(self.lo, q_lo), max(self.hi, q_hi), min(self.evalue, evalue)
        self.bits, self.gaps = self.bits + bits, self.gaps + gaps
        return ()

    def end(self):
        if self.first is None:
            return ()
        q, s, strand, slen, qlen = self.first
        spans = joined(self.spans)
        covered = sum(b - a + 1 for a, b in spans)
        identity = 100.0 * self.matched / self.aligned if self.aligned else 0.0
        return ((q, s, strand, slen, qlen, identity, 100.0 * covered / slen if slen else 0.0, covered, [{"lo": a, "hi": b} for a, b in spans], self.lo, self.hi, self.gaps, self.bits, self.evalue, len(self.spans)),)


def merge_hsps(hsps: DataFrame, *, query_scale: float = 1.0, slack: int = 5000, bucket: int = 10_000) -> DataFrame:
    """Hits (columns of ``MERGED``) from HSPs (columns of the table hsps).

    1. HSPs of a query, reference and strand are cut into copies: a new one begins where an HSP lies more
       than ``2 * slen * query_scale + slack`` behind the furthest end before it on the query.
    2. In each copy HSPs are read by falling score; one that repeats over half of its own reference span
       of a single one taken, or would stretch the copy beyond that extent, is passed over.
    3. Of hits of one query and reference that begin in one ``bucket`` of the query, also on both strands,
       the one with the highest score stays.

    Records count once (same hsp_id); a null or empty qseqid, a null sseqid or slen, a null or NaN score and
    null coordinates are left out; equal scores are read by hsp_id. Empty in, empty out.
    """
    require(hsps, *[c for c in COLUMNS if not c.startswith("_")], "qstart", "qend", "sstart", "send")
    ok = "qseqid <> '' AND sseqid IS NOT NULL AND slen IS NOT NULL AND hsp_id IS NOT NULL AND bitscore IS NOT NULL AND NOT isnan(bitscore) AND qstart IS NOT NULL AND qend IS NOT NULL AND sstart IS NOT NULL AND send IS NOT NULL"
    rows = hsps.where(ok).select(
        "qseqid", "sseqid", F.coalesce("strand", F.lit("+")).alias("strand"), "slen", F.coalesce("qlen", F.lit(0)).alias("qlen"), F.least("sstart", "send").alias("_s_lo"), F.greatest("sstart", "send").alias("_s_hi"),
        F.least("qstart", "qend").alias("_q_lo"), F.greatest("qstart", "qend").alias("_q_hi"), F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("nident", F.lit(0)).alias("nident"),
        F.coalesce("gaps", F.lit(0)).alias("gaps"), "bitscore", F.coalesce("evalue", F.lit(0.0)).alias("evalue"), "hsp_id",
    )
    pair = ["qseqid", "sseqid", "strand"]
    w = Window.partitionBy(*pair).orderBy("_q_lo", "_q_hi", "hsp_id")
    before = F.max("_q_hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("_q_lo") - before > (F.col("slen") * query_scale * 2).cast("bigint") + slack, F.lit(False))
    # A record that was loaded again lies right behind itself.
    again = F.coalesce(F.lag("hsp_id").over(w) == F.col("hsp_id"), F.lit(False))
    copies = rows.select("*", apart.alias("_apart"), again.alias("_again")).withColumn("_copy", F.count_if("_apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = fold_groups(copies.where("NOT _again").select(*COLUMNS), 4, [F.desc("bitscore"), F.col("hsp_id")], lambda: _Merge(query_scale, slack), MERGED)
    place = Window.partitionBy("qseqid", "sseqid", F.floor(F.col("query_start") / bucket)).orderBy(F.desc("bitscore"), "query_start", "strand")
    return merged.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")
