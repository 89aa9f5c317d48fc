"""Passages of test items in a corpus: shared q-grams in overlapping diagonal bands, then banded alignment of what remains."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strainspark.columns import q as quoted
from strainspark.columns import require
from strainspark.llm.textnorm import words
from strainspark.session import materialize

#: Up to this many q-grams of the items, their index is sent to every task; more are joined by a shuffle.
FEW = 2_000_000
#: Lengths of q-grams: an item's is rounded down to one of these, so that few different ones are hashed.
LENGTHS = (1, 2, 3, 4, 5, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)
#: Share of the q-grams that a window must keep, by the lemma, that a region is asked for (divided by the edits + 1).
SHARE = 0.32
#: Most bits of the map of the items' q-grams by which tasks drop other grams where they arise (32 MB).
BITS = 1 << 28
#: Characters hashed at once; longer texts are hashed in overlapping parts.
PART = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(_MULTIPLIER)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def gram_hashes(text: str, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(position of the first, hashes of all q-grams from there on), part by part: a rolling polynomial mod 2^64."""
    n = len(text) - size + 1
    if n < 1:
        return
    with np.errstate(over="ignore"):
        longest = min(len(text), PART + size - 1)
        up, down = _powers(longest + 1, _MULTIPLIER), _powers(longest + 1, _INVERSE)
        for at in range(0, n, PART):
            part = text[at : at + PART + size - 1]
            codes = _mix(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64))
            sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(codes * down[: len(part)])])
            m = len(part) - size + 1
            yield at, _mix((sums[size : size + m] - sums[:m]) * up[:m] + np.uint64(size)).view(np.int64)


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A map of ``bits`` bits in which the low bits of each hash are set, packed block by block in Spark."""
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(1 << 16, dtype=bool)
        marks[block["low"].to_numpy()] = True
        return pd.DataFrame({"block": block["block"].iloc[:1].to_numpy(), "packed": [np.packbits(marks).tobytes()]})

    slots = hashes.select(F.shiftright(slot, 16).cast("int").alias("block"), slot.bitwiseAND(F.lit((1 << 16) - 1)).cast("int").alias("low")).distinct()
    out = np.zeros((max(1, bits >> 16), 1 << 13), dtype=np.uint8)
    for r in slots.groupBy("block").applyInPandas(pack, "block int, packed binary").collect():  # no more than BITS / 8 bytes
        out[r.block] = np.frombuffer(r.packed, dtype=np.uint8)
    return out.ravel()


def _bits(hashes: DataFrame, n: int) -> tuple:
    """A broadcast map of the ``n`` hashes (column h), of at most ``BITS`` bits, and its number of bits."""
    bits = min(BITS, 1 << max(16, (32 * n).bit_length()))
    return hashes.sparkSession.sparkContext.broadcast(_bitmap(hashes, bits)), bits


def _out(ids: pa.Array, rows: list, pos: list, hashes: list) -> pa.RecordBatch:
    n = [len(p) for p in pos]
    cols = [ids.take(pa.array(np.repeat(rows, n))), pa.array(np.concatenate(pos).astype(np.int32)), pa.array(np.concatenate(hashes))]
    return pa.RecordBatch.from_arrays(cols, ["id", "pos", "h"])


def _grams(sizes: Sequence[int], bits: int, wanted):
    """Rows (id, text) to (id, pos, h): those q-grams of each of the lengths that are set in ``wanted`` (a broadcast map)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = wanted.value
        rows, pos, hashes, held = [], [], [], 0
        for batch in batches:
            ids = batch.column(0)
            for k, t in enumerate(batch.column(1).to_pylist()):
                norm = " ".join(words(t))
                for size in sizes:
                    for at, h in gram_hashes(norm, size):
                        slot = h & (bits - 1)
                        where = np.flatnonzero(keep[slot >> 3] & (128 >> (slot & 7)).astype(np.uint8))
                        if len(where):
                            rows.append(k), pos.append(where + at), hashes.append(h[where])
                            held += len(where)
                if held >= 1 << 18:
                    yield _out(ids, rows, pos, hashes)
                    rows, pos, hashes, held = [], [], [], 0
            if held:
                yield _out(ids, rows, pos, hashes)
                rows, pos, hashes, held = [], [], [], 0

    return run


def _item_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, norm, size) to (id, pos, h): all q-grams of an item's own length."""
    for batch in batches:
        for k, (t, size) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            for at, h in gram_hashes(t, size):
                yield _out(batch.column(0), [k], [np.arange(len(h)) + at], [h])


def _rarest(least: int, edits: int):
    """Items with the number of items' places that each of their q-grams has: places of the rarest q-grams, so many that
    every window of ``least`` words holds ``edits`` * size + bound of them."""

    def run(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in it:
            out = []
            for i, norm, size, bound, counts in zip(block["id"], block["norm"], block["size"], block["bound"], block["counts"]):
                counts = np.asarray(counts)
                starts = [0, *(m + 1 for m, c in enumerate(norm) if c == " "), len(norm) + 1]
                keep = np.zeros(len(counts), dtype=bool)
                for k in range(len(starts) - least):
                    x, y = starts[k], starts[k + least] - 1
                    own = counts[x : y - size + 1]
                    keep[x + np.argsort(own, kind="stable")[: edits * size + bound]] = True
                out.append(pd.DataFrame({"id": i, "pos": np.flatnonzero(keep).astype(np.int32)}))
            yield pd.concat(out) if out else pd.DataFrame({"id": block["id"][:0], "pos": np.zeros(0, np.int32)})

    return run


def _banded(band: int):
    """Rows (id, item, bound, pos, ipos) to parts of regions (id, item, band, n, lo, hi, ilo, ihi), each diagonal in two bands.

    A document's rows follow each other, so the regions of one that begins and ends within a batch are whole, and
    those below the bound are dropped before the shuffle; the others are put together behind it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, items = (batch.column(c).dictionary_encode() for c in ("id", "item"))
            bound, pos, ipos = (batch.column(c).to_numpy().astype(np.int64) for c in ("bound", "pos", "ipos"))
            i, t = (x.indices.to_numpy().astype(np.int64) for x in (ids, items))
            first = np.floor_divide(pos - ipos, band)
            twice = lambda x: np.concatenate([x, x])
            i, t, bound, pos, ipos, bands = twice(i), twice(t), twice(bound), twice(pos), twice(ipos), np.concatenate([first, first + 1])
            order = np.lexsort((bands, t, i))
            i, t, bound, pos, ipos, bands = (x[order] for x in (i, t, bound, pos, ipos, bands))
            at = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1]) | (bands[1:] != bands[:-1])]))
            n = np.diff(np.append(at, len(i)))
            ends = (ids.indices[0].as_py(), ids.indices[-1].as_py())
            keep = (n >= bound[at]) | np.isin(i[at], ends)
            spans = [f.reduceat(x, at)[keep].astype(np.int32) for x, f in ((pos, np.minimum), (pos, np.maximum), (ipos, np.minimum), (ipos, np.maximum))]
            at, n = at[keep], n[keep]
            cols = [ids.dictionary.take(pa.array(i[at])), items.dictionary.take(pa.array(t[at])), *map(pa.array, (bands[at].astype(np.int32), n, *spans))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "item", "band", "n", "lo", "hi", "ilo", "ihi"])

    return run


def banded_distance(pattern: str, text: str, shift: int, band: int, budget: int) -> int:
    """The least edits (up to ``budget`` + 1) between the pattern and a part of the text, over cells at most
    ``band`` off the diagonal ``shift`` (position in the text minus position in the pattern)."""
    return int(banded_distances([(pattern, text, shift)], band, budget)[0])


def banded_distances(pairs: Sequence[tuple[str, str, int]], band: int, budget: int) -> np.ndarray:
    """:func:`banded_distance` of many (pattern, text, shift) at once: one step for each character of the longest
    pattern, over the bands of all pairs."""
    width, longest = 2 * band + 1, max((len(p) for p, _, _ in pairs), default=0)
    sizes = np.array([len(p) for p, _, _ in pairs], dtype=np.int64)
    mine, theirs = np.zeros((len(pairs), longest), np.uint32), np.full((len(pairs), longest + width), 0xFFFFFFFF, np.uint32)
    for n, (p, t, shift) in enumerate(pairs):
        mine[n, : len(p)] = np.frombuffer(p.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lo = shift - band
        part = t[max(0, lo) : max(0, lo + len(p) + width - 1)]
        at = max(0, -lo)
        theirs[n, at : at + len(part)] = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    step = np.arange(width, dtype=np.int16)
    row = np.zeros((len(pairs), width), np.int16)
    best = np.zeros(len(pairs), np.int16)
    for i in range(longest):
        new = row + (theirs[:, i : i + width] != mine[:, i : i + 1])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(new - step, axis=1) + step
        done = sizes == i + 1
        if done.any():
            best[done] = row[done].min(axis=1)
    return np.minimum(best, budget + 1)


def longest_run(a: list[str], b: list[str]) -> int:
    """The most consecutive words that both lists hold, place by place (for short lists: all pairs of places)."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
                best = max(best, new[j])
        row = new
    return best


def compared(item: str, doc: str, shift: int, band: int, size: int, least: int, edits: int) -> tuple[int, list[tuple[int, int]]]:
    """Two cuts along the diagonals at most ``band`` off ``shift``: the most consecutive whole words that are equal on one of
    them (0 below ``least``), and the item's windows of ``least`` words (start, end) that keep as many q-grams as the
    edits leave.

    A run of equal characters with n blanks holds n - 1 whole words: both texts have a blank where their
    words begin and end. Each diagonal is read once.
    """
    x = np.frombuffer(item.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n, lo, width = len(x), shift - band, 2 * band + 1
    y = np.full(n + width, 0xFFFFFFFF, dtype=np.uint32)
    part = np.frombuffer(doc[max(0, lo) : max(0, lo + n + width - 1)].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    y[max(0, -lo) : max(0, -lo) + len(part)] = part
    blanks = np.flatnonzero(x == 32)
    if len(blanks) <= least or n < size:
        return 0, []
    same = np.lib.stride_tricks.sliding_window_view(y, n)[:width] == x
    differ = np.zeros((width, n + 1), dtype=np.int32)
    np.cumsum(~same, axis=1, out=differ[:, 1:])
    kept = np.concatenate([[0], np.cumsum((differ[:, size:] == differ[:, :-size]).any(axis=0))])
    starts, ends = blanks[:-least] + 1, blanks[least:]
    all_of = ends - starts + 1 - size
    have = kept[np.minimum(starts + all_of, len(kept) - 1)] - kept[np.minimum(starts, len(kept) - 1)]
    exact = 0
    if (have >= all_of).any():
        for eq, before in zip(same[:, blanks], differ[:, blanks]):
            # Blanks of one run have as many different characters before them.
            at = before[eq]
            if len(at) > least:
                exact = max(exact, int(np.unique(at, return_counts=True)[1].max()) - 1)
    ok = np.flatnonzero(have >= np.maximum(all_of - size * edits, 1))
    return exact if exact >= least else 0, list(zip(starts[ok].tolist(), ends[ok].tolist()))


def _check(least: int, edits: int, band: int):
    """Regions (id, item, size, cut, theirs, shift) to (id, item, n_words, n_exact). Both cuts begin and end with the
    character beside the cut, a blank where the text ends."""

    def run(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in it:
            n_words, n_exact = np.zeros(len(block), np.int32), np.zeros(len(block), np.int32)
            pairs, owner = [], []

            def flush():
                ok = banded_distances(pairs, band, edits) <= edits
                run_of, before = 0, (-1, 0)
                for (r, at), good in zip(owner, ok):
                    run_of = (run_of + 1 if before == (r, at - 1) else 1) if good else 0
                    before = (r, at)
                    if run_of:
                        n_words[r] = max(n_words[r], run_of + least - 1)
                pairs.clear(), owner.clear()

            for r, (size, cut, theirs, shift) in enumerate(zip(block["size"], block["cut"], block["theirs"], block["shift"])):
                n_exact[r], windows = compared(cut, theirs, shift, band, size, least, edits)
                for x, y in windows:
                    pairs.append((cut[x:y], theirs, x + shift))
                    owner.append((r, cut.count(" ", 0, x)))
                if len(pairs) >= 1 << 14:
                    flush()
            if pairs:
                flush()
            found = (n_words > 0) | (n_exact > 0)
            yield pd.DataFrame({"id": block["id"][found], "item": block["item"][found], "n_words": np.maximum(n_words, n_exact)[found], "n_exact": n_exact[found]})

    return run


def _normal_docs(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for block in it:
        yield pd.DataFrame({"id": block["id"], "norm": [" " + " ".join(words(t)) + " " for t in block["text"]]})


def find_leaks(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = 12, max_edits: int = 0,
) -> DataFrame:
    """Documents that hold a passage of a test item: ``doc_id``, ``item_id``, ``n_words`` of the longest one, and
    ``n_exact``, the words of the longest one that is letter for letter the item's (0: none of ``min_words``).

    A passage is at least ``min_words`` consecutive words of the item (:func:`~strainspark.llm.textnorm.words`:
    regardless of case, punctuation, markup and encoding), with at most ``max_edits`` characters edited
    in each such window. Let L be the length of an item's shortest window and q its length of q-grams, about
    (L + 1) / (3 edits + 3). q-gram lemma: of any edits * q + bound q-grams of a window a passage keeps
    bound, within a band of diagonals as wide as the edits. So

    1. each window's rarest edits * q + bound q-grams among the items are indexed (all together a window
       has enough of them at every bound up to L + 1 - q (edits + 1); ``SHARE`` of that is taken);
    2. the documents' q-grams that the index doesn't hold are dropped where they arise, by a map of bits of
       bounded size (a few pass it by chance and fall away in the join);
    3. the others are joined with the index and counted by document, item and band, each diagonal in two
       overlapping bands, where they arise (what can't reach the bound is dropped there) and after the shuffle;
    4. regions that reach the bound are kept; the documents that have one are read once more (the others
       are passed over by a map of bits of the ids, so the corpus isn't shuffled), the regions are cut out
       of both texts, and every window of a cut that keeps all the q-grams that the lemma asks for is
       aligned within its band.

    Whole texts are compared. A null or empty text, or an item of fewer words, leaks nothing, nor does an item
    with a window of at most ``max_edits`` characters; rows with a null id are left out; ids should be
    unique (texts of rows that share an id are compared one by one). Empty tables give no rows. Other
    columns aren't read.
    """
    require(docs, doc_id, doc_text)
    require(items, item_id, item_text)
    if min_words < 1 or max_edits < 0:
        raise ValueError("min_words must be at least 1, max_edits at least 0")
    if len({doc_id.lower(), item_id.lower(), "n_words", "n_exact"}) < 4:
        raise ValueError("doc_id, item_id, n_words and n_exact must be four names")
    spark = docs.sparkSession
    d = docs.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(doc_text)).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    i = items.select(F.col(quoted(item_id)).alias("id"), F.col(quoted(item_text)).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    counts = [T.StructField("n_words", T.IntegerType()), T.StructField("n_exact", T.IntegerType())]
    out = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField(item_id, items.schema[item_id].dataType), *counts])
    kind, item_kind = (x.schema["id"].dataType.simpleString() for x in (d, i))

    share = SHARE / (max_edits + 1)

    @F.udf("struct<norm:string,size:int,bound:int,pad:int>")
    def prepared(text):
        w = words(text)
        ends = np.cumsum([0, *(len(x) + 1 for x in w)])
        windows = (ends[min_words:] - ends[: max(0, len(ends) - min_words)] - 1).tolist()
        if not windows or min(windows) <= max_edits:
            return None
        size = max(n for n in LENGTHS if n <= max(1, (min(windows) + 1) // (3 * max_edits + 3)))
        # Edits near a passage's ends hide the q-grams there: as much as a window may lie outside a region's outermost ones.
        return " ".join(w), size, max(1, int((min(windows) + 1 - size * (max_edits + 1)) * share)), max(windows) + max_edits

    normal = materialize(i.select("id", prepared("text").alias("p")).where("p IS NOT NULL").select("id", "p.*"), "leak-items")
    sizes = sorted(r["size"] for r in normal.select("size").distinct().collect())  # no more than LENGTHS
    if not sizes:
        return spark.createDataFrame([], out)
    places = materialize(normal.select("id", "norm", "size").mapInArrow(_item_grams, f"id {item_kind}, pos int, h bigint"), "leak-places")
    common = places.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rarity = places.join(common, "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "n")))["n"].alias("counts"))  # of one item's text
    chosen = normal.join(rarity, "id").mapInPandas(_rarest(min_words, max_edits), f"id {item_kind}, pos int")
    index = places.join(chosen, ["id", "pos"]).join(normal.select("id", "bound"), "id")
    index = materialize(index.select(F.col("id").alias("item"), "bound", F.col("pos").alias("ipos"), "h"), "leak-index")
    n_grams = index.count()
    few = n_grams <= FEW
    wanted, bits = _bits(index.select("h"), n_grams)
    of_docs = d.mapInArrow(_grams(sizes, bits, wanted), f"id {kind}, pos int, h bigint")
    met = of_docs.join(F.broadcast(index) if few else index, "h")

    band = max_edits + 1
    bounds = normal.select(F.col("id").alias("item"), "size", "bound", "pad")
    if few:
        parts = met.select("id", "item", "bound", "pos", "ipos").mapInArrow(_banded(band), f"id {kind}, item {item_kind}, band int, n bigint, lo int, hi int, ilo int, ihi int")
    else:
        first = F.floor((F.col("pos") - F.col("ipos")) / F.lit(band)).cast("int")
        each = [F.col("pos").alias("lo"), F.col("pos").alias("hi"), F.col("ipos").alias("ilo"), F.col("ipos").alias("ihi")]
        parts = met.select("id", "item", F.explode(F.array(first, first + 1)).alias("band"), F.lit(1).alias("n"), *each)
    regions = (
        parts.groupBy("id", "item", "band")
        .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("ilo").alias("ilo"), F.max("ihi").alias("ihi"))
        .join(bounds, "item")
        .where(F.col("n") >= F.col("bound"))
        .select("id", "item", "band", "lo", (F.col("hi") + F.col("size")).alias("hi"), "ilo", (F.col("ihi") + F.col("size")).alias("ihi"), "size", "pad")
    )
    # The same passage lies in two bands: of regions with the same places the first is enough.
    regions = regions.groupBy("id", "item", "lo", "hi", "ilo", "ihi", "size", "pad").agg(F.min("band").alias("band"))
    regions = materialize(regions, "leak-regions")
    their_ids = regions.select(F.xxhash64("id").alias("h")).distinct()
    holding, id_bits = _bits(their_ids, their_ids.count())

    @F.pandas_udf("boolean")
    def may_hold(h: pd.Series) -> pd.Series:
        slot = h.to_numpy() & (id_bits - 1)
        return pd.Series((holding.value[slot >> 3] & (128 >> (slot & 7)).astype(np.uint8)) != 0)

    texts = d.where(may_hold(F.xxhash64("id"))).mapInPandas(_normal_docs, f"id {kind}, norm string")
    reach = F.col("pad") + 2 * band
    ilo, ihi = F.greatest(F.col("ilo") - F.col("pad"), F.lit(0)), F.least(F.col("ihi") + F.col("pad"), F.length("norm"))
    mine = normal.select(F.col("id").alias("item"), "norm")
    cuts = regions.join(mine, "item").select(
        "id", "item", "size", "band", F.greatest(F.col("lo") - reach, F.lit(0)).alias("lo"), (F.col("hi") + reach).alias("hi"),
        ilo.alias("ilo"), F.substring(F.concat(F.lit(" "), "norm", F.lit(" ")), ilo + 1, ihi - ilo + 2).alias("cut"),
    )
    # The band's middle as a diagonal of the cuts: its number times its width is the first diagonal of its second half.
    shift = F.col("band") * F.lit(band) + F.col("ilo") - F.col("lo")
    pairs = texts.join(cuts, "id").select("id", "item", "size", "cut", F.substring("norm", F.col("lo") + 1, F.col("hi") - F.col("lo") + 2).alias("theirs"), shift.alias("shift"))
    checked = pairs.mapInPandas(_check(min_words, max_edits, band + max_edits), f"id {kind}, item {item_kind}, n_words int, n_exact int")
    best = checked.groupBy("id", "item").agg(F.max("n_words").alias("n_words"), F.max("n_exact").alias("n_exact"))
    return best.select(F.col("id").alias(doc_id), F.col("item").alias(item_id), "n_words", "n_exact")
