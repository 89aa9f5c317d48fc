"""Languages of posts and of their parts: models per language, fitted on labelled posts, read along the words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strainspark.columns import q, require
from strainspark.llm.kneser import Model
from strainspark.llm.prose import prose_words
from strainspark.session import materialize

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt", "sv")
#: Labelled posts of each language that the models are fitted on, those with the lowest hash of their id.
SAMPLE = 500
#: Natural logs of odds that the words must offer before the language is taken to change.
SWITCH = 14.0
#: Posts of the sample have at most this many characters, so its size is bounded in bytes too.
SAMPLE_CHARS = 50_000
#: Share of held-out parts in their language whose cross-entropy stays under the limit, and the factor on
#: the language's mean that is granted besides.
ACCEPT, SLACK = 0.999, 1.25
UNKNOWN = "und"


def label_code(c: Column, languages: Sequence[str] = LANGUAGES) -> Column:
    """The language of a label like 'EN', 'en-GB' or 'en_US'; null for a missing one and for what isn't among the languages."""
    code = F.lower(F.regexp_extract(F.trim(c), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(code.isin(list(languages)), code)


def likelihood(entropy: np.ndarray, size: np.ndarray, sharpness: float) -> np.ndarray:
    """Each language's probability for parts of ``size`` characters with these cross-entropies (parts, languages): odds
    by the total, damped by the root, as neighbouring characters aren't independent."""
    logs = -sharpness * np.sqrt(size)[:, None] * (entropy - entropy.min(axis=1, keepdims=True))
    odds = np.exp(logs)
    return odds / odds.sum(axis=1, keepdims=True)


#: The values of sharpness that are tried.
GRID = np.geomspace(0.05, 50.0, 61)


def losses(entropy: np.ndarray, size: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """For each sharpness of GRID, the sum of the pieces' negative log probabilities of their true languages (columns)."""
    own = np.arange(len(truth))
    return np.array([-np.log(np.maximum(likelihood(entropy, size, s)[own, truth], 1e-12)).sum() for s in GRID])


def fitted_sharpness(entropy: np.ndarray, size: np.ndarray, truth: np.ndarray) -> float:
    """The sharpness at which the true languages (columns) of the pieces are likeliest; 1 without pieces."""
    return float(GRID[losses(entropy, size, truth).argmin()]) if len(truth) else 1.0


@dataclass
class Identifier:
    """Fitted models with their calibration: a part of n characters has no language known if its cross-entropy
    for each character is over ``mean`` + ``spread`` / sqrt(n) of the language. ``sharpness`` is the confidence's."""

    model: Model
    mean: np.ndarray
    spread: np.ndarray
    sharpness: float = 1.0

    def path(self, logs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The best language of each word, a change costing SWITCH; all posts of the block step by step together.

        ``logs``: (words, languages), post after post; ``bounds``: where posts begin, and the end.
        """
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable")
        sizes, starts = sizes[order], bounds[:-1][order]
        n_lang = logs.shape[1]
        came = np.zeros(logs.shape, dtype=np.int8)
        best = np.zeros((len(sizes), n_lang))
        last = np.zeros(len(sizes), dtype=np.int64)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step, side="left"))  # posts longer than step
            rows = starts[:live] + step
            if step:
                top = best[:live].argmax(axis=1)
                change = best[np.arange(live), top] - SWITCH
                stay = best[:live] >= change[:, None]
                came[rows] = np.where(stay, np.arange(n_lang), top[:, None])
                best[:live] = np.where(stay, best[:live], change[:, None])
            best[:live] += logs[rows]
        last[:] = best.argmax(axis=1)
        out = np.zeros(len(logs), dtype=np.int8)
        for step in range(int(sizes[0]) - 1 if len(sizes) else -1, -1, -1):
            live = int(np.searchsorted(-sizes, -step, side="left"))
            rows = starts[:live] + step
            out[rows] = last[:live]
            last[:live] = came[rows, last[:live]] if step else last[:live]
        return out

    def parts(self, texts: Iterable[str | None], most: int = 200_000) -> Iterator[tuple]:
        """(number of the text, part, language, confidence, words, first word, characters, cross-entropy), text by text."""
        held: list[list[str]] = []
        first, n = 0, 0
        for text in texts:
            w = prose_words(text)
            held.append(w)
            n += len(w)
            if n >= most:
                yield from self._parts(held, first)
                first, held, n = first + len(held), [], 0
        yield from self._parts(held, first)

    def _parts(self, posts: list[list[str]], number: int) -> Iterator[tuple]:
        vocabulary: dict[str, int] = {}
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for p in posts for w in p], dtype=np.int64)
        if not len(ids):
            return
        word_logs, word_chars = self.model.score(list(vocabulary))
        logs, chars = word_logs[ids], word_chars[ids]
        ends = np.cumsum([len(p) for p in posts])
        owner = np.repeat(np.arange(len(posts)), [len(p) for p in posts])
        starts = np.concatenate([[0], ends[:-1]])
        bounds = np.append(starts[ends > starts], len(ids))
        language = self.path(logs, bounds)
        for _ in range(2):
            at = np.flatnonzero(np.concatenate([[True], (language[1:] != language[:-1]) | (owner[1:] != owner[:-1])]))
            # A part's language is the one with the lowest cross-entropy over the whole part.
            best = np.add.reduceat(logs, at, axis=0).argmax(axis=1)
            language = np.repeat(best, np.diff(np.append(at, len(ids))))
        sums, size, words = np.add.reduceat(logs, at, axis=0), np.add.reduceat(chars, at), np.diff(np.append(at, len(ids)))
        entropy = -sums / size[:, None]
        chosen = language[at]
        own = entropy[np.arange(len(at)), chosen]
        confidence = likelihood(entropy, size, self.sharpness)[np.arange(len(at)), chosen]
        part, before = 0, -1
        for i, a in enumerate(at):
            o = int(owner[a])
            part = part + 1 if o == before else 0
            before = o
            c = chosen[i]
            name = self.model.languages[c] if own[i] <= self.mean[c] + self.spread[c] / size[i] ** 0.5 else UNKNOWN
            yield number + o, part, name, float(min(confidence[i], 1.0)), int(words[i]), int(a - starts[o]), int(size[i]), float(own[i])


SEGMENT = "part int, language string, confidence double, n_words int, first_word int, n_chars int, cross_entropy double"


def _segments(broadcast):
    def run(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        identifier = broadcast.value
        for block in it:
            rows = list(identifier.parts(block["_text"]))
            out = pd.DataFrame(rows, columns=["_n", "part", "language", "confidence", "n_words", "first_word", "n_chars", "cross_entropy"])
            keys = block.drop(columns="_text").iloc[out.pop("_n").to_numpy(dtype=np.int64)].reset_index(drop=True)
            yield pd.concat([keys, out], axis=1)

    return run


def segments(docs: DataFrame, identifier: Identifier, *, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Each post's parts in one language, in order: ``doc_id``, ``keep`` columns, ``part``, ``language``,
    ``confidence`` (0 to 1), ``n_words``, ``first_word`` (of the post's prose words), ``n_chars`` and ``cross_entropy``.

    A part whose cross-entropy for each character is over the language's calibrated limit, which is
    wider for short parts, has the language 'und'. A post without prose (null, empty, code only) has no part. Whole posts are read;
    nothing is shuffled; ids may repeat. Other columns, whatever their names, aren't read.
    """
    require(docs, doc_id, text, *keep)
    if clash := {c.lower() for c in (doc_id, *keep)} & {"part", "language", "confidence", "n_words", "first_word", "n_chars", "cross_entropy", "_text", "_n"}:
        raise ValueError(f"columns named like results: {sorted(clash)}")
    rows = docs.select(F.col(q(doc_id)), *[F.col(q(c)) for c in keep], F.col(q(text)).alias("_text"))
    out = T.StructType(rows.schema.fields[:-1] + T.StructType.fromDDL(SEGMENT).fields)
    return rows.mapInPandas(_segments(docs.sparkSession.sparkContext.broadcast(identifier)), out)


#: Characters of posts whose words a task that fits holds at once; a post isn't cut.
HELD_CHARS = 1_000_000


def _slices(texts: pd.Series) -> Iterator[slice]:
    """Runs of a block's posts, of about HELD_CHARS characters each."""
    first, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= HELD_CHARS:
            yield slice(first, i + 1)
            first, n = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def _word_counts(broadcast):
    """Labelled rows to (code, word, n): all words, or with an identifier those of parts in the label's language."""

    def run(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        identifier = broadcast.value if broadcast is not None else None
        for block in it:
            counts: dict[tuple[str, str], int] = {}
            for rows in _slices(block["text"]):
                codes, texts = block["code"].iloc[rows].to_list(), block["text"].iloc[rows]
                posts = [prose_words(t) for t in texts]
                spans = [(i, 0, len(p)) for i, p in enumerate(posts)]
                if identifier is not None:
                    spans = [(i, at, at + n) for i, _, lang, _, n, at, *_ in identifier.parts(texts) if lang == codes[i]]
                for i, x, y in spans:
                    for w in posts[i][x:y]:
                        key = (codes[i], w)
                        counts[key] = counts.get(key, 0) + 1
            yield pd.DataFrame([(c, w, n) for (c, w), n in counts.items()], columns=["code", "word", "n"])

    return run


#: Words of the pieces of held-out parts on which the confidence is fitted, in turn.
PIECES = (1, 2, 3, 5, 8, 13)


def _cut(identifier: Identifier, block: pd.DataFrame) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The pieces of each part of the rows (code, text) that is in the label's language: (language, characters, cross-entropies)."""
    for rows in _slices(block["text"]):
        code, texts = block["code"].iloc[rows].to_list(), block["text"].iloc[rows]
        posts = [prose_words(t) for t in texts]
        for i, _, lang, _, n, at, *_ in identifier.parts(texts):
            if lang != code[i] or n < 2 * max(PIECES):
                continue
            logs, size = identifier.model.score(posts[i][at : at + n])
            cuts = np.cumsum([0, *(PIECES[k % len(PIECES)] for k in range(n))])
            cuts = cuts[cuts < n]
            total, length = np.add.reduceat(logs, cuts, axis=0), np.add.reduceat(size, cuts)
            yield lang, length, -total / length[:, None]


def _pieces(broadcast):
    """Held-out rows (id, code, text) to pieces of the parts in the label's language: (code, n_chars, entropy)."""

    def run(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in it:
            codes, chars, entropies = [], [], []
            for lang, length, entropy in _cut(broadcast.value, block):
                codes += [lang] * len(length)
                chars += length.tolist()
                entropies += entropy.tolist()
            yield pd.DataFrame({"code": codes, "n_chars": chars, "entropy": entropies})

    return run


def pieces_of(held: DataFrame, identifier: Identifier) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cross-entropies, characters, true columns) of the held-out pieces, to look at: all of them come to the driver."""
    rows = held.mapInPandas(_pieces(held.sparkSession.sparkContext.broadcast(identifier)), "code string, n_chars bigint, entropy array<double>").toPandas()
    column = {name: i for i, name in enumerate(identifier.model.languages)}
    entropy = np.array(rows["entropy"].tolist(), dtype=float).reshape(len(rows), len(column))
    return entropy, rows["n_chars"].to_numpy(), rows["code"].map(column).to_numpy(dtype=np.int64)


#: Pieces whose losses a task sums up at once.
AT_ONCE = 20_000


def _losses(broadcast):
    """Held-out rows (id, code, text) to one row for each task: the number of its pieces and their losses."""

    def run(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        identifier = broadcast.value
        column = {name: i for i, name in enumerate(identifier.model.languages)}
        n, total, held, waiting = 0, np.zeros(len(GRID)), [], 0

        def summed() -> np.ndarray:
            truth = np.repeat([column[lang] for lang, _, _ in held], [len(length) for _, length, _ in held])
            return losses(np.concatenate([e for _, _, e in held]), np.concatenate([length for _, length, _ in held]), truth)

        for block in it:
            for piece in _cut(identifier, block):
                held.append(piece)
                n, waiting = n + len(piece[1]), waiting + len(piece[1])
                if waiting >= AT_ONCE:
                    total, held, waiting = total + summed(), [], 0
        if held:
            total = total + summed()
        yield pd.DataFrame({"n": [n], "loss": [total.tolist()]})

    return run


def sharpness_of(held: DataFrame, identifier: Identifier) -> float:
    """:func:`fitted_sharpness` of the held-out pieces, which stay in the tasks: the driver gets a sum for each value tried."""
    rows = held.mapInPandas(_losses(held.sparkSession.sparkContext.broadcast(identifier)), "n bigint, loss array<double>").where("n > 0").collect()
    return float(GRID[np.sum([r.loss for r in rows], axis=0).argmin()]) if rows else 1.0


def limits_of(held: DataFrame, identifier: Identifier) -> tuple[np.ndarray, np.ndarray]:
    """The languages' ``mean`` and ``spread`` by the held-out parts in the label's language; the driver gets a row for each language."""
    parts = segments(held, identifier, doc_id="id", keep=["code"]).where("language = code").select("language", "cross_entropy", "n_chars")
    own = materialize(parts, "language-parts")
    means = own.groupBy("language").agg((F.sum(F.col("cross_entropy") * F.col("n_chars")) / F.sum("n_chars")).alias("m"))
    over = (F.col("cross_entropy") - F.col("m")) * F.sqrt("n_chars")
    mean, spread = identifier.mean.copy(), identifier.spread.copy()
    for r in own.join(F.broadcast(means), "language").groupBy("language", "m").agg(F.percentile(over, F.lit(ACCEPT)).alias("q")).collect():
        i = identifier.model.languages.index(r.language)
        mean[i], spread[i] = SLACK * r.m, max(0.0, r.q)
    return mean, spread


def fit(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "lang", languages: Sequence[str] = LANGUAGES, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS,
    rounds: int = 2,
) -> Identifier:
    """Fit the models on at most ``sample`` labelled posts of each language, and calibrate them on as many others.

    The sample are the posts with the lowest hash of their id, so it doesn't depend on their order; of these,
    posts of over ``sample_chars`` characters (a bound of its size) and empty ones are left out. The
    labels are partly wrong and posts mixed: after the first fit each round keeps only the words of parts
    whose language is the label's, and fits again. Counts, limits and losses are made by Spark; the driver gets the distinct
    words of the bounded sample, and sums. Held-out posts give each language's limit of cross-entropy; pieces of 1 to 13
    words of their parts in the label's language give the sharpness at which a piece's true language is
    likeliest, so that of parts with confidence c about the share c is right. Raises ValueError if no language has a labelled post with words.
    """
    require(docs, doc_id, text, label)
    spark = docs.sparkSession
    keys = docs.select(F.col(q(doc_id)).alias("id"), label_code(F.col(q(label)), languages).alias("code")).where("code IS NOT NULL AND id IS NOT NULL")
    order = Window.partitionBy("code").orderBy(F.xxhash64("id"), "id")
    ranked = keys.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * sample)
    texts = docs.select(F.col(q(doc_id)).alias("id"), F.col(q(text)).alias("text")).where(F.length("text").between(1, sample_chars))
    chosen = materialize(texts.join(F.broadcast(ranked.dropDuplicates(["id"])), "id"), "language-sample")  # at most 2 * sample * languages ids
    # Even ranks are held out.
    train, held = chosen.where("rank % 2 = 1").select("code", "text"), chosen.where("rank % 2 = 0").select("id", "code", "text")

    model, identifier = None, None
    for _ in range(rounds + 1):
        broadcast = spark.sparkContext.broadcast(identifier) if identifier is not None else None
        counts = train.mapInPandas(_word_counts(broadcast), "code string, word string, n bigint").groupBy("code", "word").agg(F.sum("n").alias("n")).collect()
        by: dict[str, dict[str, int]] = {}
        for r in counts:
            by.setdefault(r.code, {})[r.word] = r.n
        if not by:
            break
        model = Model.fit(by)
        identifier = Identifier(model, np.full(len(model.languages), np.inf), np.zeros(len(model.languages)))
    if identifier is None:
        raise ValueError("no labelled post with words")
    return Identifier(model, *limits_of(held, identifier), sharpness_of(held, identifier))


def languages_of(parts: DataFrame, *, doc_id: str = "doc_id", keep: Sequence[str] = (), min_words: int = 12) -> DataFrame:
    """The languages of each post: ``doc_id``, ``keep``, ``language``, ``main`` BOOLEAN, ``n_words``, ``confidence``.

    The main language has the most words (of equal ones the first by name); others count with a part of
    at least ``min_words`` consecutive words. 'und' is no language.
    """
    named = parts.where(F.col("language") != UNKNOWN)
    per = named.groupBy(q(doc_id), *[q(k) for k in keep], "language").agg(F.sum("n_words").alias("n_words"), F.max("n_words").alias("_run"), F.max_by("confidence", "n_words").alias("confidence"))
    first = F.row_number().over(Window.partitionBy(q(doc_id)).orderBy(F.desc("n_words"), "language")) == 1
    return per.withColumn("main", first).where(F.col("main") | (F.col("_run") >= min_words)).select(q(doc_id), *[q(k) for k in keep], "language", "main", "n_words", "confidence")
