"""Reshaping of plain DataFrames. Helpers that keep or read the order of rows take ``order_by``."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StructType

from ..errors import DuplicateNameError, NameRepairError, SelectionError, UnknownColumnError
from ..plans.compiler import hidden


def _list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _known(df: DataFrame, names: Sequence[str]) -> None:
    if missing := [c for c in names if c not in df.columns]:
        raise UnknownColumnError(f"unknown columns: {', '.join(missing)}")


def _order(df: DataFrame, order_by) -> list[str]:
    names = _list(order_by or [])
    _known(df, names)
    return names


def _placed(order: Sequence[str]):
    """A struct that sorts like the order's columns, missing last."""
    return F.struct(*(x for k, c in enumerate(order) for x in (F.col(f"`{c}`").isNull().alias(f"m{k}"), F.col(f"`{c}`").alias(f"v{k}"))))


def _gather(df: DataFrame, keys: list[str], columns: list[str], name: str, order: list[str], item) -> DataFrame:
    first, rows = hidden("first"), hidden("rows")
    fields = F.struct(*(F.col(f"`{c}`").alias(c) for c in columns))
    entry = F.struct(_placed(order).alias("at"), fields.alias("row")) if order else F.struct(fields.alias("row"))
    calls = [F.collect_list(entry).alias(rows), *([F.min(_placed(order)).alias(first)] if order else [])]
    out = df.groupBy(*(f"`{k}`" for k in keys)).agg(*calls)
    out = out.withColumn(rows, F.transform(F.array_sort(rows) if order else F.col(rows), lambda r: r["row"]))
    if order:
        out = out.orderBy(first).drop(first)
    return item(out, rows).drop(rows)


def nest(df: DataFrame, by: str | Sequence[str], columns: Sequence[str] | None = None, name: str = "data", order_by=None) -> DataFrame:
    """Rows of each key as an array of structs, in order; keys as first seen (both only with ``order_by``)."""
    keys = _list(by)
    columns = _list(columns) if columns is not None else [c for c in df.columns if c not in keys]
    _known(df, [*keys, *columns])
    if name in keys:
        raise DuplicateNameError(f"{name!r} is a key")
    return _gather(df, keys, columns, name, _order(df, order_by), lambda out, rows: out.withColumn(name, F.col(rows)))


def unnest(df: DataFrame, column: str) -> DataFrame:
    """One row for each nested row; empty ones drop their row."""
    _known(df, [column])
    inner = df.schema[column].dataType
    if not (isinstance(inner, ArrayType) and isinstance(inner.elementType, StructType)):
        raise SelectionError(f"{column!r} holds no nested rows")
    names = inner.elementType.names
    rest = [c for c in df.columns if c != column]
    if clash := set(names) & set(rest):
        raise DuplicateNameError(f"nested columns exist already: {', '.join(sorted(clash))}")
    row = hidden("row")
    return df.withColumn(row, F.explode(f"`{column}`")).select(*(f"`{c}`" for c in rest), *(F.col(row)[c].alias(c) for c in names))


def chop(df: DataFrame, columns: str | Sequence[str], by: str | Sequence[str] | None = None, order_by=None) -> DataFrame:
    """Columns as lists for each key, missing values kept."""
    columns = _list(columns)
    keys = _list(by) if by is not None else [c for c in df.columns if c not in columns]
    _known(df, [*keys, *columns])
    return _gather(df, keys, columns, "", _order(df, order_by), lambda out, rows: out.withColumns({c: F.col(rows)[c] for c in columns}))


def unchop(df: DataFrame, columns: str | Sequence[str], keep_empty: bool = False) -> DataFrame:
    """Expand lists side by side, short ones padded; a value that is no list is a list of one, a missing one is empty."""
    columns = _list(columns)
    _known(df, columns)
    as_list = lambda c: F.col(f"`{c}`") if isinstance(df.schema[c].dataType, ArrayType) else F.when(F.col(f"`{c}`").isNotNull(), F.array(f"`{c}`"))
    z = hidden("z")
    lists = F.arrays_zip(*(F.coalesce(as_list(c), F.array().cast(ArrayType(df.schema[c].dataType.elementType if isinstance(df.schema[c].dataType, ArrayType) else df.schema[c].dataType))).alias(f"c{k}") for k, c in enumerate(columns)))
    out = df.withColumn(z, lists).withColumn(z, (F.explode_outer if keep_empty else F.explode)(z))
    return out.select(*(F.col(z)[f"c{columns.index(c)}"].alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns))


def unnest_longer(df: DataFrame, column: str, values_to: str | None = None, indices_to: str | None = None, keep_empty: bool = False) -> DataFrame:
    """One row for each element, with its index from 0; with ``keep_empty`` an empty list gives a missing value at 0."""
    _known(df, [column])
    value, index, values_to = hidden("v"), hidden("i"), values_to or column
    pos = F.posexplode_outer if keep_empty else F.posexplode
    out = df.select("*", pos(f"`{column}`").alias(index, value))
    new = [F.col(value).alias(values_to) if c == column else F.col(f"`{c}`") for c in df.columns]
    if indices_to:
        new.append(F.coalesce(F.col(index), F.lit(0)).alias(indices_to))
    names = [values_to if c == column else c for c in df.columns] + ([indices_to] if indices_to else [])
    if len(set(names)) < len(names):
        raise DuplicateNameError("unnest_longer makes equal names")
    return out.select(*new)


def unnest_wider(df: DataFrame, column: str, names_sep: str | None = None) -> DataFrame:
    """Fields, map keys or places of a list as columns. Maps and lists need one job that finds the keys or the length."""
    _known(df, [column])
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        c, kind = F.get(c, 0), kind.elementType
    if isinstance(kind, StructType):
        parts = [(n, c[n]) for n in kind.names]
    elif isinstance(kind, MapType):
        keys = [r[0] for r in df.select(F.explode(F.map_keys(c)).alias("k")).distinct().orderBy("k").collect()]
        parts = [(str(k), F.try_element_at(c, F.lit(k))) for k in keys]
    elif isinstance(kind, ArrayType):
        size = df.agg(F.max(F.size(c))).first()[0] or 0
        parts = [(str(k), F.get(c, k)) for k in range(max(0, size))]
    else:
        raise SelectionError(f"{column!r} is not nested")
    new = {(f"{column}{names_sep}{n}" if names_sep else n): v for n, v in parts}
    rest = [x for x in df.columns if x != column]
    if clash := set(new) & set(rest):
        raise DuplicateNameError(f"columns exist already: {', '.join(sorted(clash))}")
    return df.select(*(x for n in df.columns for x in ([v.alias(k) for k, v in new.items()] if n == column else [F.col(f"`{n}`")])))


def pack(df: DataFrame, column: str, columns: Sequence[str]) -> DataFrame:
    """Columns as one struct, at the place of the first."""
    columns = _list(columns)
    _known(df, columns)
    if column in df.columns and column not in columns:
        raise DuplicateNameError(f"{column!r} exists already")
    first = min(df.columns.index(c) for c in columns)
    packed = F.struct(*(F.col(f"`{c}`").alias(c) for c in columns)).alias(column)
    return df.select(*(packed if k == first else F.col(f"`{c}`") for k, c in enumerate(df.columns) if k == first or c not in columns))


def unpack(df: DataFrame, column: str, names_sep: str | None = None, remove: bool = True) -> DataFrame:
    """A struct's fields as columns, in its place or (without ``remove``) after all others."""
    return unnest_wider(df, column, names_sep) if remove else _keep(df, column, names_sep)


def _keep(df: DataFrame, column: str, names_sep: str | None) -> DataFrame:
    copy = hidden("copy")
    out = unnest_wider(df.withColumn(copy, F.col(f"`{column}`")), copy, None)
    inner = df.schema[column].dataType.names
    return out.withColumnsRenamed({n: f"{column}{names_sep}{n}" for n in inner}) if names_sep else out


def hoist(df: DataFrame, column: str, **paths: Any) -> DataFrame:
    """Values plucked from a nested column by key or index, or a list of these; what is not there is missing."""
    _known(df, [column])
    new = {}
    for name, path in paths.items():
        c, kind = F.col(f"`{column}`"), df.schema[column].dataType
        for step in path if isinstance(path, (list, tuple)) else [path]:
            if isinstance(kind, StructType):
                if step not in kind.names:
                    c, kind = F.lit(None), None
                    break
                c, kind = c[step], kind[step].dataType
            elif isinstance(kind, MapType):
                c, kind = F.try_element_at(c, F.lit(step)), kind.valueType
            elif isinstance(kind, ArrayType):
                c, kind = F.try_element_at(c, F.lit(step + 1 if step >= 0 else step)), kind.elementType
            else:
                raise SelectionError(f"{column!r} has nothing at {step!r}")
        new[name] = c
    if clash := set(new) & set(df.columns):
        raise DuplicateNameError(f"columns exist already: {', '.join(sorted(clash))}")
    return df.withColumns(new)


def pivot_wider(df: DataFrame, id_cols: str | Sequence[str], names_from: str, values_from: str, names: Sequence[Any] | None = None, validate: str = "eager") -> DataFrame:
    """A column for each name. One job checks that keys are unique and, without ``names``, finds them."""
    ids = _list(id_cols)
    _known(df, [*ids, names_from, values_from])
    if names is None or validate == "eager":
        n = hidden("n")
        keys = df.groupBy(*(f"`{k}`" for k in dict.fromkeys([*ids, names_from]))).agg(F.count(F.lit(1)).alias(n))
        c = F.col(f"`{names_from}`")
        found = keys.agg(F.max(n).alias("n"), F.array_sort(F.collect_set(c)).alias("names"), F.max(c.isNull()).alias("missing")).first()
        if validate == "eager" and (found["n"] or 0) > 1:
            raise DuplicateNameError("pivot_wider's keys do not identify values")
        if names is None:
            names = [None] * bool(found["missing"]) + list(found["names"])
    return df.groupBy(*(f"`{k}`" for k in ids)).pivot(names_from, list(names)).agg(F.first(f"`{values_from}`"))


def pivot_longer(df: DataFrame, columns: Sequence[str], names_to: str = "name", values_to: str = "value") -> DataFrame:
    columns = _list(columns)
    _known(df, columns)
    kinds = {df.schema[c].dataType for c in columns}
    if len(kinds) > 1:
        raise NameRepairError("columns of unlike types have no common value column")
    rest = [c for c in df.columns if c not in columns]
    if {names_to, values_to} & set(rest) or names_to == values_to:
        raise NameRepairError("the new columns' names exist already")
    return df.unpivot([F.col(f"`{c}`") for c in rest], [F.col(f"`{c}`") for c in columns], names_to, values_to)


def drop_na(df: DataFrame, columns: str | Sequence[str] | None = None) -> DataFrame:
    names = _list(columns) if columns is not None else df.columns
    _known(df, names)
    return df.na.drop(how="any", subset=names)


def fill(df: DataFrame, columns: str | Sequence[str], direction: str = "down", order_by=None, by: str | Sequence[str] | None = None) -> DataFrame:
    """Missing values from the nearest row above (down), below (up), or first one and then the other.

    Without ``by`` the whole table is one ordered window, which one task sorts; with it, one for each key.
    """
    if direction not in ("down", "up", "downup", "updown"):
        raise SelectionError(f"unknown direction {direction!r}")
    columns, order = _list(columns), _order(df, order_by)
    _known(df, columns)
    if not order:
        raise SelectionError("fill reads the order of rows: give order_by")
    window = Window.partitionBy(*(f"`{k}`" for k in _list(by or []))).orderBy(*(F.col(f"`{c}`").asc_nulls_last() for c in order))
    down, up = window.rowsBetween(Window.unboundedPreceding, 0), window.rowsBetween(0, Window.unboundedFollowing)

    def filled(c: str):
        c = F.col(f"`{c}`")
        above, below = F.last(c, ignorenulls=True).over(down), F.first(c, ignorenulls=True).over(up)
        return {"down": above, "up": below, "downup": F.coalesce(above, below), "updown": F.coalesce(below, above)}[direction]

    return df.withColumns({c: filled(c) for c in columns})


def separate(df: DataFrame, column: str, into: Sequence[str], sep: str = "_", remove: bool = True) -> DataFrame:
    """Pieces between matches of a pattern; the last takes the rest, what is short is missing."""
    _known(df, [column])
    into = _list(into)
    parts = F.split(F.col(f"`{column}`").cast("string"), sep, len(into) if len(into) > 1 else -1)
    out = df.withColumn(held := hidden("parts"), parts).withColumns({n: F.get(held, k) for k, n in enumerate(into)}).drop(held)
    return out.drop(column) if remove and column not in into else out


def separate_rows(df: DataFrame, columns: str | Sequence[str], sep: str = ",") -> DataFrame:
    """One row for each piece; several columns must have equally many. A missing value gives one missing row."""
    columns = _list(columns)
    _known(df, columns)
    z = hidden("z")
    lists = [F.split(F.col(f"`{c}`").cast("string"), sep) for c in columns]
    zipped = F.arrays_zip(*(x.alias(f"c{k}") for k, x in enumerate(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))
    if len(lists) > 1:
        same = F.lit(True)
        for x in lists[1:]:
            same = same & (F.coalesce(F.size(x), F.lit(-1)) == F.coalesce(F.size(lists[0]), F.lit(-1)))
        zipped = F.when(same, zipped).otherwise(F.raise_error("separate_rows: the columns have unlike numbers of pieces"))
    out = df.withColumn(z, zipped).withColumn(z, F.explode_outer(z))
    return out.select(*(F.col(z)[f"c{columns.index(c)}"].alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns))


def extract(df: DataFrame, column: str, into: Sequence[str], regex: str, remove: bool = True) -> DataFrame:
    """Groups of a pattern as columns; without a match, or beyond the groups, missing."""
    _known(df, [column])
    into, groups = _list(into), re.compile(regex).groups
    c = F.col(f"`{column}`").cast("string")
    held = hidden("text")
    out = df.withColumn(held, c)
    out = out.withColumns({n: F.when(F.col(held).rlike(regex), F.regexp_extract(held, regex, k)) if k <= groups else F.lit(None).cast("string") for k, n in enumerate(into, 1)}).drop(held)
    return out.drop(column) if remove and column not in into else out


def unite(df: DataFrame, column: str, columns: Sequence[str], sep: str = "_", remove: bool = True, na_rm: bool = False) -> DataFrame:
    """Columns joined as text, at the place of the first; missing is empty, or left out with ``na_rm``."""
    columns = _list(columns)
    _known(df, columns)
    texts = [F.col(f"`{c}`").cast("string") for c in columns]
    made = F.concat_ws(sep, *(texts if na_rm else [F.coalesce(t, F.lit("")) for t in texts])).alias(column)
    first = min(df.columns.index(c) for c in columns)
    out = []
    for k, c in enumerate(df.columns):
        if k == first:
            out.append(made)
        if c != column and not (remove and c in columns):
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes missing, so that missing has one form."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c in floats}) if floats else df
