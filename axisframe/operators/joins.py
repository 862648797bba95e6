"""Metadata joins onto one axis, with their relationship checked before a row is produced."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DuplicateNameError, JoinRelationshipError, UnknownColumnError
from ..plans.compiler import hidden, in_order

RELATIONSHIPS = ("one-to-one", "one-to-many", "many-to-one", "many-to-many")


def as_frame(df: DataFrame, other: DataFrame | Mapping[str, Sequence[Any]]) -> DataFrame:
    if isinstance(other, DataFrame):
        return other
    import pandas as pd

    return df.sparkSession.createDataFrame(pd.DataFrame(dict(other)))


def placed(df: DataFrame, other: Any, right_order: Sequence[str] = ()) -> tuple[DataFrame, list[tuple[str, bool]]]:
    """The right table and its order: ``right_order``, or that of an AxisTable or a mapping; a DataFrame has none of its own.

    Order columns are hidden copies, which the join carries along.
    """
    if hasattr(other, "_obs"):  # a table's metadata, with hidden copies of what it is ordered by
        a = other._obs
        names = [(c, hidden("o"), down) for c, down in a.order]
        frame, order = a.df.select(*(F.col(f"`{c}`") for c in a.public), *(F.col(f"`{c}`").alias(n) for c, n, _ in names)), [(n, down) for _, n, down in names]
    elif isinstance(other, DataFrame):
        frame, order = other, []
    else:
        import pandas as pd

        held = pd.DataFrame(dict(other))
        held[at := hidden("o")] = range(len(held))
        frame, order = df.sparkSession.createDataFrame(held), [(at, False)]
    if right_order:
        copies = {c: hidden("o") for c in right_order}
        if missing := [c for c in right_order if c not in frame.columns]:
            raise UnknownColumnError(f"unknown columns: {', '.join(missing)}")
        frame, order = frame.withColumns({n: F.col(f"`{c}`") for c, n in copies.items()}), [(n, False) for n in copies.values()]
    return frame, order


def _keys(public: Sequence[str], other: DataFrame, by) -> list[str]:
    names = [by] if isinstance(by, str) else list(by) if by is not None else [c for c in public if c in other.columns]
    if not names:
        raise JoinRelationshipError("the tables share no column to join by")
    if missing := [k for k in names if k not in public or k not in other.columns]:
        raise UnknownColumnError(f"join keys are not in both tables: {', '.join(missing)}")
    return names


def _policies(relationship: str, multiple: str, unmatched: str, na_matches: str) -> None:
    for value, allowed, what in ((relationship, RELATIONSHIPS, "relationship"), (multiple, ("error", "first", "all"), "multiple"), (unmatched, ("drop", "error"), "unmatched"), (na_matches, ("na", "never"), "na_matches")):
        if value not in allowed:
            raise JoinRelationshipError(f"{what} is one of {', '.join(allowed)}, not {value!r}")


def _on(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], na_matches: str):
    parts = [F.col(a).eqNullSafe(F.col(b)) if na_matches == "na" else F.col(a) == F.col(b) for a, b in keys]
    return reduce(lambda a, b: a & b, parts)


def _repeats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.count(F.lit(1)).alias(n := hidden("n"))).where(F.col(n) > 1).select(*(f"`{k}`" for k in keys))


def enrich(df: DataFrame, public: list[str], other: DataFrame, how: str, *, by=None, relationship="many-to-one", multiple="error", unmatched="drop", na_matches="na", suffixes=("", "_right"), right_order=(), own_order=(), validate="eager") -> tuple[DataFrame, list[str], dict[str, str]]:
    """The joined frame, its public columns and what left columns were renamed to. ``how``: left, inner, right or full."""
    _policies(relationship, multiple, unmatched, na_matches)
    keys = _keys(public, other, by)
    eager = validate == "eager"
    if how == "right" and not own_order:
        raise JoinRelationshipError("a right join has the right table's order: give right_order")
    carried = {c for c, _ in own_order}
    renamed = {k: hidden("k") for k in keys}
    right = other.withColumnsRenamed(renamed)
    right_keys = list(renamed.values())
    pairs = [(f"`{k}`", renamed[k]) for k in keys]
    on = lambda l, r: _on(l, r, pairs, na_matches)
    if multiple == "first":
        if not own_order:
            raise JoinRelationshipError("the first of several matches needs the right table's order: give right_order")
        order = in_order(own_order)
        at = hidden("r")
        right = right.withColumn(at, F.row_number().over(Window.partitionBy(*right_keys).orderBy(*order))).where(F.col(at) == 1).drop(at)
    elif eager and (multiple == "error" or relationship in ("one-to-one", "many-to-one")):
        if not _repeats(right, right_keys).isEmpty():
            raise JoinRelationshipError("keys of the right table are not unique")
    if eager and relationship in ("one-to-one", "one-to-many") and not _repeats(df, keys).isEmpty():
        raise JoinRelationshipError("keys of the left table are not unique")
    if eager and multiple == "all":  # a left row may meet one right row at most, or the axis would repeat it
        if not _repeats(right, right_keys).join(df, on(df, right), "left_semi").isEmpty():
            raise JoinRelationshipError("the join would repeat rows of the axis")
    if eager and (unmatched == "error" or how in ("right", "full")):
        if not df.join(right, on(df, right), "left_anti").isEmpty() and (unmatched == "error"):
            raise JoinRelationshipError("rows of the axis have no match")
        if how in ("right", "full") and not right.join(df, on(df, right), "left_anti").isEmpty():
            raise JoinRelationshipError("rows of the right table would be added to the axis")
    shared = [c for c in other.columns if c in public and c not in keys]
    left_new = {c: c + suffixes[0] for c in shared}
    right_new = {c: c + suffixes[1] for c in shared}
    extra = [c for c in other.columns if c not in keys and c not in carried]
    names = [left_new.get(c, c) for c in public] + [right_new.get(c, c) for c in extra]
    if len(set(names)) != len(names):
        raise DuplicateNameError("the join's suffixes leave equal column names")
    stand_in = {c: hidden("j") for c in extra}
    met = df.join(right.withColumnsRenamed(stand_in), on(df, right), "inner" if how in ("inner", "right") else "left").drop(*right_keys, *(carried if how != "right" else ()))
    met = met.withColumnsRenamed({k: v for k, v in left_new.items() if k != v})
    met = met.withColumnsRenamed({v: right_new.get(c, c) for c, v in stand_in.items()})
    return met, names, left_new


def only(df: DataFrame, public: list[str], other: DataFrame, how: str, *, by=None, na_matches="na") -> DataFrame:
    """Rows with (semi) or without (anti) a match; only the right table's keys are read."""
    _policies("many-to-one", "error", "drop", na_matches)
    keys = _keys(public, other, by)
    renamed = {k: hidden("k") for k in keys}
    right = other.select(*(F.col(f"`{k}`").alias(v) for k, v in renamed.items()))
    return df.join(right, _on(df, right, [(f"`{k}`", v) for k, v in renamed.items()], na_matches), f"left_{how}")
