"""Helpers for column names: operators add working columns without touching the caller's."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def require(df: DataFrame, *names: str) -> None:
    """Raise ValueError if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def free(taken: Iterable[str], base: str) -> str:
    """``base``, with underscores appended until no column has that name in any case."""
    low = {t.lower() for t in taken}
    while base.lower() in low:
        base += "_"
    return base


def q(name: str) -> str:
    """The name quoted for use inside col() and expr()."""
    return "`" + name.replace("`", "``") + "`"
