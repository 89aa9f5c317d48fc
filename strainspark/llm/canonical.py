"""Freely typed values mapped to a list: character n-gram index, weighted cosine, threshold, margin, exact check."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainspark.columns import q, require
from strainspark.session import materialize

#: Index rows (one for each entry and n-gram) that are sent to every task; a longer list is joined by a shuffle.
FEW = 500_000
#: The place of an entry's own text before its phrases.
WHOLE = -1


_PARTED = re.compile(r"(?:[^\w.]|_)+")
_JOINED = re.compile(r"[\W_]")


def normalise(text: str) -> str:
    """Lower case without accents, everything but letters, digits and the dots of abbreviations as single blanks."""
    text = text.casefold()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return _PARTED.sub(" ", text).strip()


def contained(phrase: str, text: str, budget: int) -> tuple[int, int]:
    """The least edits (insert, delete, replace, swap of neighbours) between ``phrase`` and a part of ``text``
    (budget + 1 if more), and the end of the first such part.

    Columns of the table of edits are kept as the bits of whole numbers: one step for each character of
    the text, whatever the phrase's length.
    """
    if (at := text.find(phrase)) >= 0:
        return 0, at + len(phrase)
    if not budget:
        return 1, 0
    m, where = len(phrase), {}
    for i, c in enumerate(phrase):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, d0, before = full, 0, 0, 0
    now = least = m
    end = 0
    for j, c in enumerate(text, 1):
        eq = where.get(c, 0)
        swap = ((~d0 & eq) << 1) & before
        d0 = (((eq & up) + up) ^ up) | eq | down | swap
        more, less = down | (~(d0 | up) & full), d0 & up
        now += bool(more & top) - bool(less & top)
        more, less = more << 1, less << 1
        up, down = (less | ~(d0 | more)) & full, d0 & more & full
        before = eq
        if now < least:
            least, end = now, j
    return (least, end) if least <= budget else (budget + 1, 0)


def least_edits(phrases: Sequence[str], texts: Sequence[str]) -> np.ndarray:
    """The edits that :func:`contained` finds with any budget, for many phrases of at most 63 characters at once: one step
    for each place of the longest text, over all pairs."""
    # Phrases and texts repeat: each is spelt once.
    each, of = np.unique(np.array(phrases, dtype=object), return_inverse=True)
    read, text_of = np.unique(np.array(texts, dtype=object), return_inverse=True)
    sizes = np.array([len(p) for p in each], dtype=np.int64)[of]
    lengths = np.array([len(t) for t in read], dtype=np.int64)
    n, longest = len(phrases), int(lengths.max(initial=0))
    # Characters as small numbers: where[character, phrase] has the bits of its places.
    number = {c: k for k, c in enumerate(sorted(set("".join(each))), 1)}
    where = np.zeros((len(number) + 1, len(each)), dtype=np.uint64)
    for i, p in enumerate(each):
        for j, c in enumerate(p):
            where[number[c], i] |= np.uint64(1 << j)
    codes = np.zeros((longest, len(read)), dtype=np.int64)
    for i, t in enumerate(read):
        codes[: len(t), i] = [number.get(c, 0) for c in t]
    lengths = lengths[text_of]
    one = np.uint64(1)
    full = (one << sizes.astype(np.uint64)) - one
    top = one << (sizes - 1).astype(np.uint64)
    up, down, d0, before = full.copy(), np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    now, least = sizes.copy(), sizes.copy()
    for j in range(longest):
        eq = where[codes[j, text_of], of]
        swap = ((~d0 & eq) << one) & before
        d0 = (((eq & up) + up) ^ up) | eq | down | swap
        more, less = down | (~(d0 | up) & full), d0 & up
        now = now + ((more & top) != 0) - ((less & top) != 0)
        more, less = more << one, less << one
        up, down = (less | ~(d0 | more)) & full, d0 & more & full
        before = eq
        least = np.where((now < least) & (j < lengths), now, least)
    return least


def _expanded(value: str, phrases: list[str]) -> str:
    """The value's letters and digits without blanks; a token that ends in a dot becomes the word of the
    phrases that begins with it (but for one edit, if none does) and isn't there in full."""
    if "." not in value:
        return _JOINED.sub("", value)
    tokens = value.split()
    there = {t for t in tokens if not t.endswith(".")}
    spare = [w for p in phrases for w in p.split() if w not in there]
    out = []
    for t in tokens:
        if t.endswith(".") and len(t) > 2:
            stem = t.rstrip(".")
            full = next((w for w in spare if w.startswith(stem)), None)
            if full is None and len(stem) > 4:
                full = next((w for w in spare if len(w) > len(stem) and contained(stem, w[: len(stem) + 1], 1)[0] <= 1), None)
            if full:
                spare.remove(full)
                t = full
        out.append(t)
    return _JOINED.sub("", "".join(out))


def distance(value: str, phrases: list[str], edits: int, sure: bool = True) -> tuple[int, int, int] | None:
    """Edits by which a normalised value holds all phrases, and the place of the last one; None if it doesn't.

    Each phrase may have ``edits``, and one for every three letters (four if not ``sure``). A phrase that
    isn't there as a whole may be there word by word.
    """
    text, total, lo, hi = _expanded(value, phrases), 0, 0, 0
    for p in phrases:
        whole = p.replace(" ", "")
        budget = min(edits, len(whole) // (3 if sure else 4))
        d, hi = contained(whole, text, budget)
        if d > budget and " " in p:
            d = sum(contained(w, text, min(budget, len(w) // 3))[0] for w in p.split())
        if d > budget:
            return None
        total, lo = total + d, max(0, hi - len(whole))
    return total, lo, hi


def _prepared(n: int):
    """Rows of a text (and what else there is) with ``norm`` and ``grams``, the distinct n-grams of the normalised text
    with a blank on either side, as whole numbers (dots don't count)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = [normalise(t) for t in batch.column(0).to_pylist()]
            grams, offsets = gram_codes([t.replace(".", "") for t in norm], n)
            cols = [*batch.columns, pa.array(norm, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams))]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "norm", "grams"])

    return run


def gram_codes(texts: Sequence[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets): the distinct n-grams of each of ' text ', all texts at once. A text shorter than n is one gram."""
    padded = [f" {t} ".ljust(n) for t in texts]
    sizes = np.array([len(p) for p in padded], dtype=np.int64)
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    whole = np.zeros(max(0, len(codes) - n + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            # Three characters of 21 bits fit; longer grams wrap around and are hashes.
            whole = whole * np.uint64(1 << 21 if n <= 3 else 0x9E3779B97F4A7C15) + codes[i : i + len(whole)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.maximum(sizes - n + 1, 0))
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    first = np.concatenate([[0], np.cumsum(sizes - n + 1)])[:-1]
    own = whole[np.arange(len(owner)) - np.repeat(first, sizes - n + 1) + np.repeat(starts, sizes - n + 1)].view(np.int64)
    order = np.lexsort((own, owner))
    own, owner = own[order], owner[order]
    new = np.ones(len(own), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
    counts = np.bincount(owner[new], minlength=len(texts))
    return own[new], np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)


def _scored(threshold: float, edits: int, sure: float, exact: bool):
    """Candidates (value, norm, grams, entry, own, phrases) to (value, entry, dot, score, d, lo, hi): how much of the entry's
    text and of each phrase the value covers, and the exact check of those over the threshold."""

    def weights(x: dict) -> tuple[str, float, dict]:
        return x["norm"], x["total"], {g["g"]: g["w2"] for g in x["grams"]}

    def possible(near: list, known: dict, entry: list, norm: list) -> list:
        """Of the candidates those that may hold the first phrase of one short word within the most edits."""
        asked = [(k, p) for k in near for p in [next((p for p, _, _ in known[entry[k]][1] if " " not in p and len(p) < 64), None)] if p]
        if not asked:
            return near
        d = least_edits([p for _, p in asked], [_expanded(norm[k], [p for p, _, _ in known[entry[k]][1]]) for k, _ in asked])
        out = {k for (k, p), x in zip(asked, d) if x > min(edits, len(p) // 3)}
        return [k for k in near if k not in out]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            value, norm, grams, entry, own, phrases = batch.columns
            out, rows, near = [], [], []
            texts, ids, mine, last = norm.to_pylist(), entry.to_pylist(), {}, None
            for k, e in enumerate(ids):
                if e not in known:
                    known[e] = weights(own[k].as_py()), [weights(p) for p in phrases[k].as_py()]
                if texts[k] != last:
                    last, its = texts[k], set(grams[k].values.to_numpy().tolist())
                if all(sum(x for c, x in each.items() if c in its) >= total * threshold * threshold for _, total, each in known[e][1]):
                    near.append(k)
                    mine[k] = its
            for k in possible(near, known, ids, texts) if exact else near:
                (_, length, w), named = known[ids[k]]
                dot = sum(x for c, x in w.items() if c in mine[k])
                score = math.sqrt(dot / length)
                found = distance(texts[k], [p for p, _, _ in named], edits, score >= sure) if exact else (0, 0, 0)
                if found is not None:
                    rows.append(k)
                    out.append((dot, score, *found))
            if rows:
                cols = [pa.array(c, kind) for c, kind in zip(zip(*out), (pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()))]
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([value.take(at), entry.take(at), *cols], ["value", "entry", "dot", "score", "d", "lo", "hi"])

    return run


def canonicalise(
    values: DataFrame, value: str, entries: DataFrame, *, entry_id: str = "entry_id", entry: str = "entry", required: str | None = None, several: bool = False,
    n: int = 3, threshold: float = 0.3, margin: float = 0.02, edits: int = 2, sure: float = 0.65,
) -> DataFrame:
    """Each distinct value and the entries that it means: ``value``, ``entry_id`` (null: none), ``score``.

    1. Values are deduplicated and normalised (:func:`normalise`).
    2. An entry has phrases: those in the column ``required`` (all of which a value must name), else its
       whole text. Candidates come from an inverted index of the character n-grams of each entry's rarest
       phrase, a gram weighing ln(1 + entries / entries that have it). Of a phrase only its heaviest grams
       are listed, so many that the others together can't reach the threshold.
    3. The score is a weighted cosine: with ``required`` that of the entry and the part of the value that
       covers it, so other words of the value don't lower it; a candidate falls away of which any phrase,
       scored alike, is below ``threshold``. Else it is that of the whole value and the entry, and a
       candidate below ``threshold`` falls away.
    4. With ``required`` an exact check follows on the candidates that are left: those go whose phrases the
       value doesn't hold within ``edits`` edits each (:func:`distance`; fewer where the score is below ``sure``).
    5. The best score is accepted if it leads the next one by ``margin``. Of candidates closer than that the
       one with the fewest edits is accepted, or none if they are equal in that too. With ``several`` this
       holds for each place of the value: candidates found elsewhere in it are no rivals.

    Null and blank values are left out; an entry that is null or blank is never meant, nor one with no
    phrase; entries should differ (equal ones are in a tie, so no match). An empty list matches nothing.
    Values of only punctuation match nothing. Other columns of either table aren't read.
    """
    require(values, value)
    require(entries, entry_id, entry, *([required] if required else []))
    if value.lower() in ("entry_id", "score"):
        raise ValueError(f"a value column can't be named {value}, like a result column")
    listed = entries.select(F.col(q(entry_id)).alias("entry"), F.col(q(entry)).alias("text"), *([F.col(q(required)).alias("phrases")] if required else [])).where("trim(text) <> ''")
    kind = listed.schema["entry"].dataType.simpleString()
    texts = listed.select("text", "entry", F.lit(WHOLE).alias("at"))
    if required:
        texts = texts.unionByName(listed.select("entry", F.posexplode("phrases").alias("at", "text")).where("text IS NOT NULL"))
    phrases = materialize(texts.mapInArrow(_prepared(n), f"text string, entry {kind}, at int, norm string, grams array<bigint>").where("norm <> ''"), "canonical-phrases")
    size = phrases.select("entry").distinct().count()

    posted = phrases.select("entry", "at", "norm", F.explode("grams").alias("g"))
    weight = posted.groupBy("g").agg((F.log(F.lit(1.0) + F.lit(float(size)) / F.count_distinct("entry"))).alias("w")).select("g", (F.col("w") * F.col("w")).alias("w2"))
    heavy_first = F.reverse(F.array_sort(F.collect_list(F.struct("w2", "g"))))
    weighed = posted.join(weight, "g").groupBy("entry", "at", "norm").agg(heavy_first.alias("grams"), F.sum("w2").alias("total"))
    # The rarest phrase of an entry finds it: rarer phrases are named by fewer entries.
    weighed = weighed.withColumn("n_entries", F.count(F.lit(1)).over(Window.partitionBy("norm")))
    weighed = materialize(weighed, "canonical-weights")
    finder = (weighed.where(F.col("at") != WHOLE) if required else weighed).groupBy("entry").agg(F.min_by(F.struct("norm", "grams", "total"), F.struct("n_entries", "at")).alias("x"))
    found_by = finder.select("entry", F.col("x.norm").alias("finder"))
    keys = finder.select("x.*").dropDuplicates(["norm"])
    # A gram is listed while those before it leave the threshold in reach; the others can't make a match alone.
    rest = lambda i: F.aggregate(F.slice("grams", i + 1, F.size("grams")), F.lit(0.0), lambda s, x: s + x["w2"])
    listing = F.filter("grams", lambda x, i: rest(i) >= F.col("total") * (threshold * threshold * 0.999999))
    keys = keys.select(F.col("norm").alias("finder"), "total", listing.alias("listing"))
    unlisted = F.col("total") - F.aggregate("listing", F.lit(0.0), lambda s, x: s + x["w2"])
    # What the listed grams must bring so that the threshold can be reached with all the others.
    need = F.col("total") * (threshold * threshold * 0.999999) - unlisted
    index = materialize(keys.select("finder", need.alias("need"), F.inline("listing")).select("g", "finder", "w2", "need"), "canonical-index")
    whole = weighed.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("at", "norm", "grams", "total"))).alias("phrases")).join(found_by, "entry")
    whole = whole.select("entry", "finder", F.col("phrases")[0].alias("own"), F.slice("phrases", 2, 1 << 30).alias("phrases"))
    whole = materialize(whole, "canonical-entries")
    few = index.limit(FEW + 1).count() <= FEW
    small = F.broadcast if few else lambda df: df

    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = values.select(F.col(q(value)).alias("value")).where("trim(value) <> ''").distinct()
    own = distinct.mapInArrow(_prepared(n), "value string, norm string, grams array<bigint>").where("norm <> ''")
    own = materialize(own.select(F.monotonically_increasing_id().alias("v"), "value", "norm", "grams"), "canonical-values")
    # A value's grams arise in one task: the sums need no further shuffle.
    spread = own.select("v", "grams").repartition(parts, "v").select("v", F.explode("grams").alias("g"))
    met = spread.join(small(index), "g").groupBy("v", "finder").agg(F.sum("w2").alias("dot"), F.max("need").alias("need"))
    met = met.where("dot >= need").select("v", "finder")
    met = own.join(met, "v").join(small(whole), "finder")
    scored = met.select("value", "norm", "grams", "entry", "own", "phrases").mapInArrow(
        _scored(threshold, edits, sure, required is not None), f"value string, entry {kind}, dot double, score double, d int, lo int, hi int"
    )
    if not required:
        # The value's own length: a gram that no entry has weighs like the rarest.
        rare = math.log(1.0 + size) ** 2
        lengths = spread.join(small(weight), "g", "left").groupBy("v").agg(F.sqrt(F.sum(F.coalesce("w2", F.lit(rare)))).alias("v_len"))
        lengths = own.select("v", "value").join(lengths, "v").select(F.col("value").alias("of"), "v_len")
        # score is sqrt(dot) / e_len here, so sqrt(dot) * score is dot / e_len.
        scored = scored.join(lengths, F.col("value") == F.col("of")).withColumn("score", F.sqrt("dot") * F.col("score") / F.col("v_len")).where(F.col("score") >= threshold)
    # Rivals of a place: within the margin the edits decide.
    named = scored.groupBy("value").agg(F.collect_list(F.struct("entry", "score", "d", "lo", "hi")).alias("m"))
    rival = (lambda x, y: (F.least(x.hi, y.hi) - F.greatest(x.lo, y.lo)) * 2 > F.least(x.hi - x.lo, y.hi - y.lo)) if several and required else (lambda x, y: F.lit(True))
    behind = lambda x, y: (y.score >= x.score + margin) | ((y.score > x.score - margin) & (y.d <= x.d))
    kept = F.filter("m", lambda x: ~F.exists("m", lambda y: (y.entry != x.entry) & rival(x, y) & behind(x, y)))
    best = named.select("value", F.explode(kept).alias("x")).select(F.col("value").alias("of"), F.col("x.entry").alias("entry"), F.col("x.score").alias("score"))
    return distinct.join(best, F.col("value") == F.col("of"), "left").select(F.col("value").alias(value), F.col("entry").alias("entry_id"), "score")
