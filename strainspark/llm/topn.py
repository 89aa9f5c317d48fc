"""The N highest rows of every group: sorted runs, merged by a loser tree that seeks past what it has put out."""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strainspark.columns import q, require

#: Rows in one packed piece of a run.
PIECE = 1 << 12
#: Pieces that are taken in together, still packed, when one is due.
AHEAD = 64


class LoserTree:
    """A tournament over sorted runs: the inner nodes keep the losers, so one path is replayed for each step.

    A run is an iterator of keys in ascending order that raises StopIteration at its end.
    """

    def __init__(self, heads: Sequence):
        self.k = len(heads)
        self.heads = list(heads)  # None: the run is at its end
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _replay(self, i: int) -> None:
        """Let run i, whose head is new, climb; while the tree is built, the first to reach a node waits there."""
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = i
                return
            if self._beats(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    @property
    def winner(self) -> int:
        return self.tree[0]

    def replace(self, head) -> None:
        """Put the winner's next head (None at its end) into the tournament."""
        i = self.tree[0]
        self.heads[i] = head
        self._replay(i)


class _Run:
    """Pieces of one sorted run, of which one is unpacked at a time. ``starts`` are the rows at which a group begins, for
    seeking."""

    def __init__(self, width: int):
        self.width, self.packed = width, deque()
        self.at_group = self.row = self.n = 0

    def add(self, raw: bytes) -> None:
        self.packed.append(raw)
        if self.row >= self.n:
            self._open()

    def _open(self) -> None:
        """The next piece, if this one is used up and another is there."""
        while self.row >= self.n and self.packed:
            table = pa.Table.from_batches(_unpack(self.packed.popleft()))
            self.cols = [c.to_pylist() for c in table.columns[: self.width]]
            group, n = table.column(0).combine_chunks(), table.num_rows
            change = np.ones(n, dtype=bool)
            if n > 1:
                change[1:] = pa.compute.not_equal(group.slice(1), group.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            self.starts = np.append(np.flatnonzero(change), n).tolist()
            self.at_group, self.row, self.n = 0, 0, n

    def head(self):
        return None if self.row >= self.n else tuple(c[self.row] for c in self.cols)

    def step(self):
        self.row += 1
        if self.row >= self.starts[self.at_group + 1]:
            self.at_group += 1
            self._open()
        return self.head()

    def seek(self, group):
        """To the first row of the next group, which may begin in a later piece."""
        while self.row < self.n and self.cols[0][self.row] == group:
            self.at_group += 1
            self.row = self.starts[self.at_group]
            self._open()
        return self.head()


def merge_runs(pieces: Iterable[tuple], width: int, n: int) -> Iterator[tuple]:
    """The first ``n`` different keys of each group (a key's first field), over all runs, in order.

    ``pieces`` are (first group, run, packed rows) in order of their first group, a run's in their own order. A
    piece is taken in before the first row of its first group is put out, so of each run one unpacked piece is
    held, and besides at most ``AHEAD`` packed ones; runs that are used up are forgotten.
    """
    source = iter(pieces)
    due = next(source, None)
    runs: dict[int, _Run] = {}
    own: list[_Run] = []
    tree = None
    group, last, done = None, None, 0
    while True:
        key = tree.heads[tree.winner] if tree is not None else None
        if due is not None and (key is None or key[0] >= due[0]):
            for _ in range(AHEAD):
                if due is None:
                    break
                runs.setdefault(due[1], _Run(width)).add(due[2])
                due = next(source, None)
            runs = {r: x for r, x in runs.items() if x.head() is not None}
            own = list(runs.values())
            tree = LoserTree([x.head() for x in own]) if own else None
            continue
        if key is None:
            return
        run = own[tree.winner]
        if key[0] != group:
            group, last, done = key[0], None, 0
        if done >= n:
            tree.replace(run.seek(group))
            continue
        if key != last:
            yield key
            last, done = key, done + 1
        tree.replace(run.step())


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(raw: bytes) -> list[pa.RecordBatch]:
    return list(pa.ipc.open_stream(raw))


def _make_runs(width: int, n: int):
    """Rows sorted by (bucket, key): at most ``n`` different keys of each group stay; each bucket's are packed into pieces
    (bucket, first group, run, piece, packed)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().taskAttemptId()
        held: list[pa.RecordBatch] = []
        state: dict = {"last": None, "group": None, "in_group": 0, "bucket": None, "piece": 0, "rows": 0}

        def flush():
            if held:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                raw = _pack(whole)
                row = [pa.array([state["bucket"]], pa.int32()), whole.column(0).slice(0, 1), pa.array([task], pa.int64()), pa.array([state["piece"]], pa.int32()), pa.array([raw], pa.binary())]
                held.clear()
                state["piece"], state["rows"] = state["piece"] + 1, 0
                yield pa.RecordBatch.from_arrays(row, ["bucket", "first", "run", "piece", "packed"])

        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            bucket = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.select(list(range(1, width + 1)))
            # A row counts when its key differs from the one before it.
            new_group, new_key = np.ones(size, dtype=bool), np.ones(size, dtype=bool)
            if size > 1:
                differ = [pa.compute.not_equal(c.slice(1), c.slice(0, size - 1)).to_numpy(zero_copy_only=False) for c in keys.columns]
                new_group[1:] = differ[0]
                new_key[1:] = np.logical_or.reduce(differ)
            first = tuple(c[0].as_py() for c in keys.columns)
            same_group = state["last"] is not None and first[0] == state["group"]
            new_group[0], new_key[0] = not same_group, first != state["last"]
            seen = np.cumsum(new_key)
            began = np.maximum.accumulate(np.where(new_group, np.arange(size), -1))
            rank = seen - np.where(began >= 0, seen[began] - 1, -state["in_group"])
            keep = new_key & (rank <= n)
            state["last"] = tuple(c[size - 1].as_py() for c in keys.columns)
            state["group"], state["in_group"] = state["last"][0], int(rank[-1])
            kept, at = keys.filter(pa.array(keep)), bucket[keep]
            borders = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)] if len(at) else [0]
            for x, y in zip(borders, borders[1:]):
                if at[x] != state["bucket"]:
                    yield from flush()
                    state["bucket"], state["piece"] = int(at[x]), 0
                held.append(kept.slice(x, y - x))
                state["rows"] += y - x
                if state["rows"] >= PIECE:
                    yield from flush()
        yield from flush()

    return run


def _merge(width: int, n: int, names: list[str], kinds: list[pa.DataType]):
    """Pieces sorted by bucket, first group, run and piece: each bucket's runs are merged as their pieces come in."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        group, score, row_id, rank = zip(*rows)
        cols = [group, [0.0 - x for x in score], row_id, rank]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(batch.column("bucket").to_pylist(), batch.column("first").to_pylist(), batch.column("run").to_pylist(), (x.as_py() for x in batch.column("packed")))

        for _, own in itertools.groupby(pieces(), key=lambda p: p[0]):
            block: list[tuple] = []
            group, rank = None, 0
            for key in merge_runs((p[1:] for p in own), width, n):
                group, rank = key[0], rank + 1 if rank and key[0] == group else 1
                block.append((group, key[1], key[-1], rank))
                if len(block) >= 1 << 14:
                    yield out(block)
                    block = []
            if block:
                yield out(block)

    return run


PIECES = [T.StructField("run", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("packed", T.BinaryType())]


def _key(df: DataFrame, name: str, way: str) -> Column:
    """A column that is never null and ascends in the wanted order: null comes last, NaN counts as the highest."""
    kind, c = df.schema[name].dataType, F.col(q(name))
    if way not in ("asc", "desc"):
        raise ValueError(f"order of {name}: asc or desc, not {way}")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = c.cast("double")
        high = F.lit(float("-inf") if way == "desc" else float("inf"))
        return F.when(c.isNull(), F.lit(float("inf"))).when(F.isnan(c), high).otherwise((-c if way == "desc" else c) + F.lit(0.0))
    if isinstance(kind, T.IntegralType):
        c = c.cast("bigint")
        return F.coalesce(F.bitwise_not(c) if way == "desc" else c, F.lit((1 << 63) - 1))
    if way == "asc" and isinstance(kind, T.StringType):
        return F.coalesce(F.concat(F.lit("0"), c), F.lit("1"))
    raise ValueError(f"can't order by {name} {kind.simpleString()} {way}")


def top_n(df: DataFrame, group: str, score: str, ties: Sequence[tuple[str, str]], row_id: str, n: int, *, buckets: int | None = None) -> DataFrame:
    """The ``n`` rows of each group with the highest score: ``group``, ``score`` DOUBLE, ``row_id``, ``rank`` INT.

    1. Each task sorts its own rows by bucket (hash of the group), group, score and ties, and keeps the
       first ``n`` of each group, so a group of any size shrinks to n rows a task before anything is
       moved. What is left of a bucket is a sorted run, stored packed in the shuffle.
    2. A task gets the pieces of all runs of its buckets in order of their first group, merges the runs through a
       loser tree as their pieces come in (of each run one piece is unpacked), and after n rows of a group moves
       every run on to its next group without looking at the rows between.

    Equal scores are ordered by the ``ties`` (column, 'asc' or 'desc'), then by the lower ``row_id``.
    Rows equal in all of these are one row. A row with a null group, null id, or a null or NaN score
    is left out. In a tie column null ranks last and NaN as infinity. A group of fewer rows gives all
    of them, an empty table gives none. No other column is read, whatever its name. Numbers can be
    'asc' or 'desc', strings only 'asc'. ``buckets`` defaults to 4 for each shuffle partition; a task's
    memory grows with the number of runs (one piece each), not with the rows of its buckets.
    """
    require(df, group, score, row_id, *(c for c, _ in ties))
    if n < 1:
        raise ValueError("n must be at least 1")
    if len({group.lower(), score.lower(), row_id.lower(), "rank"}) < 4:
        raise ValueError("group, score, row_id and rank must be four names")
    buckets = buckets or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.col(q(score)).cast("double")
    keys = [F.col(q(group)).alias("_g"), (-value + F.lit(0.0)).alias("_s"), *[_key(df, c, w).alias(f"_t{i}") for i, (c, w) in enumerate(ties)], F.col(q(row_id)).alias("_id")]
    width = len(keys)
    rows = df.where(F.col(q(group)).isNotNull() & F.col(q(row_id)).isNotNull() & value.isNotNull() & ~F.isnan(value))
    rows = rows.select(F.pmod(F.xxhash64(F.col(q(group))), F.lit(buckets)).cast("int").alias("_b"), *keys)
    runs = rows.sortWithinPartitions(*rows.columns).mapInArrow(_make_runs(width, n), T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("first", df.schema[group].dataType), *PIECES]))
    packed = runs.repartition("bucket").sortWithinPartitions("bucket", "first", "run", "piece")
    out = T.StructType([T.StructField(group, df.schema[group].dataType), T.StructField(score, T.DoubleType()), T.StructField(row_id, df.schema[row_id].dataType), T.StructField("rank", T.IntegerType())])
    return packed.mapInArrow(_merge(width, n, out.names, [to_arrow_type(f.dataType) for f in out]), out)
