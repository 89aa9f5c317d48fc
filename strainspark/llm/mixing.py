"""Mixing sources to target weights: token counts, repetition rates, copies, and the shares reached."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strainspark.columns import free, q, require
from strainspark.session import materialize

TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are cut before merging, published with it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=1)
def _encoding(path: str):
    import tiktoken

    if not Path(path).exists():
        from pyspark import SparkFiles

        path = SparkFiles.get(Path(path).name)
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str):
    def count(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(path)
        for s in it:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return F.pandas_udf(count, T.LongType())


def with_tokens(df: DataFrame, text: str, out: str = "n_tokens", *, tokenizers: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """``df`` with the number of tokens of ``text`` in a public vocabulary; null and empty texts have 0.

    Texts are encoded whole, however long; special tokens' strings are ordinary text. Raises ValueError if
    there is a column ``out`` already. The vocabulary is read by the workers from the folder ``tokenizers``
    or, where it isn't there, from the files that the job ships (``spark.files``).
    """
    require(df, text)
    if free(df.columns, out) != out:
        raise ValueError(f"there is a column {out} already")
    return df.withColumn(out, _counter(f"{tokenizers}/{ranks}")(F.col(q(text))))


def source_key(c: Column) -> Column:
    """A source's name as it is compared: without outer blanks, in lower case; blank is null."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


#: Targets up to this number are sent to every task; more are joined by a shuffle, skewed sources split by AQE.
FEW = 50_000


class Mix:
    """Sizes and rates of one mixture. ``docs`` holds ``id``, ``source``, ``text``; ``targets`` the columns
    ``source``, ``target_share`` and ``max_repeats``.

    Every document counts towards the total, also without a source or of a source without a target;
    only those of a source with a target are put out. Sources are compared by :func:`source_key`.
    Repeated targets count once; different rows for one source add their shares, and the largest
    max_repeats holds. A null share is 0, a null max_repeats is no cap, a target without a source is
    left out. Without documents all rates are 0. Other columns of either table aren't read. With ``size`` that
    column holds the documents' sizes (null and negative ones are 0), and no text is read.
    """

    def __init__(
        self, docs: DataFrame, targets: DataFrame, *, id: str = "doc_id", source: str = "source", text: str = "text", size: str | None = None,
        seed: int = 42, tokenizers: str = TOKENIZERS, ranks: str = RANKS,
    ):
        require(docs, id, source, size or text)
        require(targets, "source", "target_share", "max_repeats")
        if id.lower() in ("source", "n_tokens", "copy"):
            raise ValueError(f"an id can't be named {id}, like a result column")
        self.id, self.seed = id, seed
        own = [F.col(q(id)).alias("id"), source_key(F.col(q(source))).alias("key")]
        if size:
            sized = docs.select(*own, F.greatest(F.coalesce(F.col(q(size)).cast("bigint"), F.lit(0)), F.lit(0)).alias("n_tokens"))
        else:
            sized = with_tokens(docs.select(*own, F.col(q(text)).alias("text")), "text", tokenizers=tokenizers, ranks=ranks)
        #: id, key, n_tokens: what a document's text comes to, encoded once.
        self.sized = materialize(sized.select("id", "key", "n_tokens"), "mix-sizes")
        per = self.sized.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
        self.per_source = materialize(per, "mix-sources")
        self.total = self.per_source.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        t = targets.select("source", "target_share", "max_repeats").distinct().withColumn("key", source_key(F.col("source"))).where("key IS NOT NULL")
        t = t.groupBy("key").agg(F.min("source").alias("source"), F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce(F.col("max_repeats").cast("double"), F.lit(float("inf")))).alias("cap"))
        self.few = t.limit(FEW + 1).count() <= FEW
        want = F.col("target_share") * F.lit(float(self.total))
        joined = t.join(self.per_source, "key", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        rate = F.when(F.col("tokens") > 0, F.least(F.col("cap"), want / F.col("tokens"))).otherwise(0.0)
        #: source, key, target_share, cap, tokens, rate, want (tokens that the share comes to).
        self.rates = joined.select("source", "key", "target_share", "cap", "tokens", rate.alias("rate"), want.alias("want"))

    def copies(self) -> DataFrame:
        """``id``, ``key``, ``n_tokens``, ``n``: floor(rate) copies of each document, and one more with the
        probability of the rest, drawn from a hash of the seed and the id: the same at every run."""
        r = self.rates.select(F.col("key").alias("of"), "rate")
        both = self.sized.join(F.broadcast(r) if self.few else r, F.col("key") == F.col("of"))
        draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(self.seed).cast("string"), F.col("id").cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
        n = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")
        return both.select("id", "key", "n_tokens", n.cast("int").alias("n"))

    def documents(self) -> DataFrame:
        """``id`` (under its own name), ``source`` as compared, ``n_tokens`` and ``copy`` (1, 2, ...)."""
        c = self.copies().where("n > 0")
        return c.select(F.col("id").alias(self.id), F.col("key").alias("source"), "n_tokens", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))

    def short(self) -> DataFrame:
        """The rates of the sources that the cap keeps from their share: all their documents are put out as often as
        they may be, and the tokens put out are still fewer than wanted (as for a source without any)."""
        got = self.copies().groupBy("key").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("reached"), F.min("n").alias("least"))
        out = self.rates.join(got, "key", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
        return out.where((F.col("want") > F.col("reached")) & ((F.col("tokens") == 0) | (F.col("least") >= F.col("cap"))))

    def shares(self) -> DataFrame:
        """For each target: ``source``, ``target_share``, ``rate``, ``n_documents`` put out, ``n_tokens`` and the
        ``share`` of all tokens put out that it really reached (null when none are)."""
        got = materialize(self.copies().groupBy("key").agg(F.sum("n").alias("n_documents"), F.sum(F.col("n") * F.col("n_tokens")).alias("n_tokens")), "mix-got")
        whole = got.agg(F.sum("n_tokens")).first()[0]
        out = self.rates.join(got, "key", "left")
        return out.select(
            "source", "target_share", "rate", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
            (F.coalesce("n_tokens", F.lit(0)) / F.lit(whole or None).cast("double")).alias("share"),
        )
