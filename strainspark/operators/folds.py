"""Rules that read a group's rows one by one in order: each group's rows stream through a task, sorted by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


class Fold:
    """State of one group. ``add`` takes a row (a tuple of the input columns) and returns rows to put out now;
    ``end`` returns those due after the last one."""

    def add(self, row: tuple) -> Iterable[tuple]:
        return ()

    def end(self) -> Iterable[tuple]:
        return ()


def fold_groups(df: DataFrame, n_keys: int, order: Sequence[Column], make: Callable[[], Fold], schema: T.StructType | str) -> DataFrame:
    """Run a fold over each group of the first ``n_keys`` columns, its rows in ``order`` (which must decide ties).

    Spark brings a group together and sorts it, spilling if it has to; the task holds the fold's state
    only, never the group. A group goes through one task, so keys should be as fine as the rule allows.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = [f.name for f in schema]
    kinds = [to_arrow_type(f.dataType) for f in schema]
    keys = df.columns[:n_keys]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fold, held = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n_keys] != group or fold is None:
                    if fold is not None:
                        held.extend(fold.end())
                    group, fold = row[:n_keys], make()
                held.extend(fold.add(row))
                if len(held) >= 1 << 14:
                    yield out(held)
                    held = []
        if fold is not None:
            held.extend(fold.end())
        if held:
            yield out(held)

    ordered = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*[F.col(k) for k in keys], *order)
    return ordered.mapInArrow(run, schema)
