"""Rows by columns matrices with a choice of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainspark.columns import q
from strainspark.operators.wide import MAX_COLUMNS, attributes


def cell(kind: str, *, gene: str = "gene", identity: str = "identity_pct", coverage: str = "coverage_pct", depth: str = "depth", fraction: str = "allele_fraction") -> Column:
    """The aggregate that fills a cell: binary, count, genes (distinct), identity, coverage, depth, fraction (the
    greatest that isn't null) or symbol ('identity/coverage' of the best row, whole percents)."""
    best = F.max(F.struct(q(identity), q(coverage)))
    whole = lambda c: F.bround(c, 0).cast("bigint").cast("string")
    kinds = {
        "binary": F.lit(1), "count": F.count(F.lit(1)), "genes": F.count_distinct(q(gene)), "identity": F.max(q(identity)), "coverage": F.max(q(coverage)),
        "depth": F.max(q(depth)), "fraction": F.max(q(fraction)), "symbol": F.concat(whole(best[identity]), F.lit("/"), whole(best[coverage])),
    }
    if kind not in kinds:
        raise ValueError(f"cell {kind}: one of {', '.join(kinds)}")
    return F.max(F.lit(1)) if kind == "binary" else kinds[kind]


def long_matrix(df: DataFrame, row: str, column: str, value: Column) -> DataFrame:
    """``row``, ``column``, ``value`` of the cells that have rows."""
    return df.groupBy(q(row), q(column)).agg(value.alias("value"))


def matrix(df: DataFrame, row: str, column: str, value: Column, *, columns: Sequence[str] | None = None, rows: DataFrame | None = None, absent=0, most: int = MAX_COLUMNS) -> DataFrame:
    """One row for each ``row`` value, one column for each of ``columns`` (all found, in order, if not given).

    Cells without rows hold ``absent`` (None leaves null). ``rows`` (a DataFrame with the column ``row``) keeps
    rows that have no cell. Null row or column values make no cell. Cells are aggregated before the pivot,
    which is given its columns and so scans once.
    """
    known = df.where(F.col(q(row)).isNotNull() & F.col(q(column)).isNotNull())
    if columns is None:
        columns = attributes(known, column, most=most)
    cells = long_matrix(known, row, column, value)
    wide = cells.groupBy(q(row)).pivot(q(column), list(columns)).agg(F.first("value")) if columns else cells.select(q(row)).distinct()
    if rows is not None:
        wide = rows.select(q(row)).where(F.col(q(row)).isNotNull()).distinct().join(wide, row, "left")
    return wide.fillna(absent, subset=[c for c in columns]) if absent is not None and columns else wide
