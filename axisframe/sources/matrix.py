"""Matrices that are aligned to an axis: columns of the axis's own frame, so no verb can put them out of step."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AxisFrameError, UnknownColumnError

LAYOUTS = ("dense_array", "sparse_struct", "wide")


@dataclass(frozen=True)
class Matrix:
    """``columns``: the array or struct column, or with layout wide a column for each slot."""

    columns: tuple[str, ...]
    layout: str = "dense_array"
    names: tuple[str, ...] = ()
    slots: tuple[int, ...] = ()

    def with_features(self, pairs: Sequence[tuple[str, int]]) -> Matrix:
        return replace(self, names=tuple(n for n, _ in pairs), slots=tuple(s for _, s in pairs))

    def at(self, slot: int) -> Column:
        """The value at a slot; NaN is missing, and what a sparse row doesn't hold is 0."""
        if self.layout == "wide":
            value = F.col(f"`{self.columns[slot]}`")
        elif self.layout == "sparse_struct":
            c = F.col(self.columns[0])
            value = F.coalesce(F.get(c["values"], F.array_position(c["indices"], slot).cast("int") - 1), F.lit(0))
            value = F.when(c.isNotNull(), value)
        else:
            value = F.get(F.col(self.columns[0]), slot)
        return F.when(~F.isnan(value), value)

    def column(self, name: str) -> Column:
        hits = [s for n, s in zip(self.names, self.slots, strict=True) if n == name]
        if not hits:
            raise UnknownColumnError(f"unknown feature {name!r}")
        return self.at(hits[0])


def check_budget(df: DataFrame, widths: Sequence[int], most: int | None) -> None:
    """Refuse a request for more than ``most`` matrix values, over all sources together, before any is read."""
    if most is None:
        return
    if most < 0:
        raise AxisFrameError("max_matrix_values is None or at least 0")
    if (wide := sum(widths)) and (cells := wide * df.count()) > most:
        raise AxisFrameError(f"the request would materialise {cells} matrix values, more than max_matrix_values={most}")
