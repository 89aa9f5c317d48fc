"""Entity, attribute, value rows into one row per entity with typed columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainspark.columns import free, q, require

#: Most attributes that become columns; a map per entity never holds more.
MAX_COLUMNS = 4000


def attributes(df: DataFrame, attribute: str, *, most: int = MAX_COLUMNS) -> list[str]:
    """The distinct attributes in order: they are column names, so their number must be small.

    Raises ValueError beyond ``most`` rather than dropping any; null is no attribute.
    """
    found = [r[0] for r in df.select(F.col(q(attribute)).cast("string").alias("a")).where("a IS NOT NULL").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"over {most} attributes: name the ones wanted")
    return sorted(found)


def cells(df: DataFrame, entity: str, attribute: str, value: str, keys: Sequence[str] | None = None, *, order: str | None = None) -> DataFrame:
    """Each entity's attribute resolved to one value: ``entity``, ``attribute``, ``value`` STRING,
    ``disagree`` BOOLEAN (the rows hold at least two different values).

    The value is the one with the highest ``order`` column (latest), else the highest itself; the
    lowest text decides what remains tied. Rows with a null entity, attribute or value are no cells.
    """
    require(df, entity, attribute, value)
    rows = df.select(F.col(q(entity)).alias("entity"), F.col(q(attribute)).cast("string").alias("attribute"), F.col(q(value)).alias("value"), (F.col(q(order)) if order else F.lit(0)).alias("_o"))
    rows = rows.where("entity IS NOT NULL AND attribute IS NOT NULL AND value IS NOT NULL")
    if keys is not None:
        rows = rows.where(F.col("attribute").isin(list(keys))) if keys else rows.limit(0)
    chosen = F.max_by("value", F.struct(F.col("_o"), F.col("value"))) if order else F.max("value")
    return rows.groupBy("entity", "attribute").agg(chosen.cast("string").alias("value"), (F.min("value") < F.max("value")).alias("disagree"))


def column_names(keys: Sequence[str], *taken: str) -> dict[str, str]:
    """A column name for each key: its own, with underscores behind it where a key before it or a ``taken`` name
    (``cast_failures`` and ``disagreements`` always are) is the same but for case."""
    out: dict[str, str] = {}
    used = {"cast_failures", "disagreements", *(t.lower() for t in taken)}
    for k in keys:
        out[k] = free(used, k)
        used.add(out[k].lower())
    return out


def widen(
    df: DataFrame, entity: str, attribute: str, value: str, *, keys: Sequence[str] | None = None, types: Mapping[str, str] | str = "double",
    order: str | None = None, most: int = MAX_COLUMNS, names: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per entity: ``entity``, a typed column for each key, then ``cast_failures``
    MAP<STRING,STRING> (attribute to the text that its type can't hold) and ``disagreements``
    ARRAY<STRING> (attributes whose rows disagree, sorted).

    Values are first resolved per entity and attribute (:func:`cells`), which also combines a hot
    entity's rows before they are moved; the entity's pairs become a map of at most ``len(keys)``
    entries, from which the columns are projected. ``types`` is one type for all or one by key (string
    where none is given). An attribute outside ``keys`` gives no column; keys default to all
    attributes found (:func:`attributes`). A key without a value, and a value that can't be cast, is
    null; only the latter is in ``cast_failures``. Rows with a null entity, attribute or value are left
    out, repeated rows change nothing, an empty table gives no rows. ``names`` gives columns other names
    than their keys' (:func:`column_names` finds some that don't clash). Clashing columns (each other,
    the entity, a result column) raise ValueError; the names of other columns don't matter. More than
    ``most`` attributes raise ValueError; :func:`cells` gives the same cells in long form, however many.
    """
    if keys is None:
        keys = attributes(df, attribute, most=most)
    keys = list(dict.fromkeys(keys))
    called = {k: (names or {}).get(k, k) for k in keys}
    lower = [n.lower() for n in called.values()]
    clash = {entity.lower(), "cast_failures", "disagreements"} & set(lower)
    if clash or len(set(lower)) < len(keys):
        raise ValueError(f"keys that clash, also without regard to case: {sorted(clash) or keys}")
    kind = (lambda k: types) if isinstance(types, str) else (lambda k: types.get(k, "string"))
    pairs = (
        cells(df, entity, attribute, value, keys, order=order)
        .groupBy("entity")
        .agg(F.map_from_entries(F.collect_list(F.struct("attribute", "value"))).alias("_m"), F.sort_array(F.collect_list(F.when(F.col("disagree"), F.col("attribute")))).alias("_d"))
    )

    def typed(k: str) -> Column:
        return F.try_element_at("_m", F.lit(k)).try_cast(kind(k))

    columns = [typed(k).alias(called[k]) for k in keys]
    by_type: dict[str, list[str]] = {}
    for k in keys:
        by_type.setdefault(kind(k), []).append(k)

    def uncast(t: str) -> Column:
        wrong = F.map_filter("_m", lambda k, v: v.try_cast(t).isNull())
        return wrong if len(by_type) == 1 else F.map_filter(wrong, lambda k, v: k.isin(by_type[t]))

    failed = [uncast(t) for t in by_type if t != "string"]
    failures = F.map_concat(*failed) if failed else F.map_filter("_m", lambda k, v: F.lit(False))
    return pairs.select(F.col("entity").alias(entity), *columns, failures.alias("cast_failures"), F.col("_d").alias("disagreements"))


def narrow(wide: DataFrame, entity: str, names: Mapping[str, str]) -> DataFrame:
    """The cells of a table made by :func:`widen`, read from its columns: ``entity`` (under its own name), ``attribute``,
    ``value`` and ``disagree``. ``names`` is key to column; the columns have one type. An empty cell gives no row.
    """
    if not names:
        return wide.select(q(entity), F.lit("").alias("attribute"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("disagree")).limit(0)
    columns = F.arrays_zip(F.array(*map(F.lit, names)).alias("attribute"), F.array(*[F.col(q(c)) for c in names.values()]).alias("value"))
    there = F.filter(columns, lambda x: x["value"].isNotNull())
    return wide.select(q(entity), "disagreements", F.inline(there)).select(q(entity), "attribute", "value", F.array_contains("disagreements", F.col("attribute")).alias("disagree"))
