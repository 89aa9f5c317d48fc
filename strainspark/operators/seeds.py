"""Sequences found in others by shared k-mers on one diagonal: a native search that gives HSP rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strainspark.columns import q, require
from strainspark.functions.sequences import revcomp


def _seeds(df: DataFrame, key: str, seq: str, k: int, prefix: str) -> DataFrame:
    """A row for each k-mer: key, 0-based place and the k-mer's hash; k-mers with other letters than bases are left out."""
    s = F.upper(q(seq))
    places = F.explode(F.sequence(F.lit(0), F.length(s) - k)).alias(prefix + "at")
    rows = df.where((F.length(q(seq)) >= k) & F.col(q(key)).isNotNull()).select(F.col(q(key)).alias(prefix + "id"), s.alias("_s"), places)
    word = F.substring("_s", F.col(prefix + "at") + 1, F.lit(k))
    return rows.where(~word.rlike("[^ACGT]")).select(prefix + "id", prefix + "at", F.xxhash64(word).alias("h"))


def _extended(gain: float, loss: float, drop: float):
    """Ends of runs after extension; an equal base counts ``gain``, another minus ``loss``, ``drop`` is in equal bases."""

    def reach(a: str, b: str, i: int, j: int, step: int) -> int:
        score = best = n = far = 0
        while 0 <= i < len(a) and 0 <= j < len(b) and best - score <= drop * gain:
            n += 1
            score += gain if a[i] == b[j] and a[i] in "ACGT" else -loss
            if score > best or (score == best and a[i] == b[j]):
                best, far = score, n
            i, j = i + step, j + step
        return far

    def run(qs: pd.Series, ss: pd.Series, lo: pd.Series, hi: pd.Series, d: pd.Series) -> pd.DataFrame:
        ends = [(x - reach(a, b, x - 1, x - 1 - z, -1), y + reach(a, b, y, y - z, 1)) for a, b, x, y, z in zip(qs, ss, lo, hi, d)]
        return pd.DataFrame(ends, columns=["lo", "hi"], dtype="int32")

    return run


def search(queries: DataFrame, subjects: DataFrame, *, qid: str = "qseqid", qseq: str = "seq", sid: str = "sseqid", sseq: str = "seq", k: int = 11, gap: int = 20, min_length: int = 20, min_identity: float = 80.0, drop: float = 20.0) -> DataFrame:
    """Ungapped matches of both strands: ``qseqid``, ``sseqid``, ``qstart``, ``qend``, ``sstart``, ``send``, ``length``, ``nident``, ``pident``.

    k-mers of both sides meet in an equi join; on each diagonal of a pair, those that lie within ``gap`` of the
    last are one run from the first k-mer's start to the last one's end. A run is extended base by base to both
    sides to where its score is highest: an equal base counts 1, another what keeps the added part at
    ``min_identity``, and it ends where the score is ``drop`` below the best. Runs that then overlap are one match;
    its identity is counted base by base. Subjects are searched on both strands; on the reverse one ``sstart`` is
    greater than ``send``. A match without k equal bases in a row isn't found. Score by identity and coverage: there is no alignment statistic. Ids are unique.
    Nulls, short and empty sequences match nothing. A k-mer that many sequences share is a skewed join key,
    which AQE splits.
    """
    require(queries, qid, qseq)
    require(subjects, sid, sseq)
    one = subjects.select(F.col(q(sid)).alias("s_id"), F.upper(q(sseq)).alias("_s"))
    strands = F.explode(F.array(F.struct(F.lit(1).alias("strand"), F.col("_s").alias("_s")), F.struct(F.lit(-1).alias("strand"), revcomp(F.col("_s")).alias("_s"))))
    both = one.select("s_id", strands.alias("x")).select(F.struct("s_id", "x.strand").alias("s_id"), "x._s")
    met = _seeds(queries, qid, qseq, k, "q_").join(_seeds(both, "s_id", "_s", k, "s_"), "h").select("q_id", "s_id", "q_at", (F.col("q_at") - F.col("s_at")).alias("d"))
    w = Window.partitionBy("q_id", "s_id", "d").orderBy("q_at")
    new = F.coalesce(F.col("q_at") - F.lag("q_at").over(w) > k + gap, F.lit(True))
    runs = met.withColumn("_new", new).withColumn("run", F.count_if("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("q_id", "s_id", "d", "run").agg(F.min("q_at").alias("lo"), (F.max("q_at") + k).alias("hi"))
    qs = queries.select(F.col(q(qid)).alias("q_id"), F.upper(q(qseq)).alias("_q"))
    extend = F.pandas_udf(_extended(100.0 - min_identity, min_identity, drop), "lo int, hi int")
    longer = spans.join(qs, "q_id").join(both, "s_id").select("q_id", "s_id", "d", "_q", "_s", extend("_q", "_s", "lo", "hi", "d").alias("x")).select("q_id", "s_id", "d", "_q", "_s", "x.*")
    w = Window.partitionBy("q_id", "s_id", "d").orderBy("lo", "hi")
    fresh = F.coalesce(F.col("lo") >= F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    longer = longer.withColumn("_new", fresh).withColumn("run", F.count_if("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.col("hi") - F.col("lo")
    whole = longer.groupBy("q_id", "s_id", "d", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("_q").alias("_q"), F.first("_s").alias("_s")).where(n >= min_length)
    cut = whole.select("*", F.split(F.substring("_q", F.col("lo") + 1, n), "").alias("_a"), F.split(F.substring("_s", F.col("lo") - F.col("d") + 1, n), "").alias("_b"))
    same = F.size(F.filter(F.zip_with("_a", "_b", lambda a, b: (a == b) & (a != "")), lambda x: x))
    first, last, turned = F.col("lo") - F.col("d") + 1, F.col("hi") - F.col("d"), F.length("_s") + 1
    forward = F.col("s_id.strand") > 0
    out = cut.select(
        F.col("q_id").alias("qseqid"), F.col("s_id.s_id").alias("sseqid"), (F.col("lo") + 1).alias("qstart"), F.col("hi").alias("qend"),
        F.when(forward, first).otherwise(turned - first).alias("sstart"), F.when(forward, last).otherwise(turned - last).alias("send"), n.alias("length"), same.alias("nident"),
    )
    return out.withColumn("pident", 100.0 * F.col("nident") / F.col("length")).where(F.col("pident") >= min_identity)
