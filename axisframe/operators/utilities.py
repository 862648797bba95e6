"""Helpers for samples, features, names and palettes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicateNameError, SelectionError, SizeMismatchError, UnknownColumnError
from ..functions import selectors as S
from ..plans.compiler import hidden
from .joins import as_frame
from .table import OBS, VAR, AxisTable, axis_name


def sample_meta(table: AxisTable, sample: str, *, include: Any = None, exclude: Any = None, on_conflict: str = "error") -> DataFrame:
    """One row for each sample, as first seen, of metadata that is constant within it. ``first`` takes the first value."""
    if on_conflict not in ("error", "first"):
        raise SelectionError("on_conflict is error or first")
    a = table._obs
    a.resolve(sample)
    drop = a.resolve(exclude) if exclude is not None else []
    names = [c for c in (a.resolve(include) if include is not None else a.public) if c != sample and c not in drop]
    ctx = a.context()
    first, place = hidden("first"), ctx.place()
    differ = [F.max(F.col(f"`{c}`").isNull().cast("int")) + F.least(F.count_distinct(F.col(f"`{c}`")), F.lit(2)) for c in names]
    kept = [F.min_by(F.col(f"`{c}`"), place).alias(c) for c in names]
    calls = [*kept, F.min(place).alias(first), *(d.alias(f"{first}_{k}") for k, d in enumerate(differ) if on_conflict == "error")]
    out = ctx.df.groupBy(F.col(f"`{sample}`")).agg(*calls)
    if on_conflict == "error" and names:
        bad = out.agg(*(F.max(F.col(f"{first}_{k}")).alias(f"b{k}") for k in range(len(names)))).first()
        if conflicts := [c for k, c in enumerate(names) if (bad[k] or 0) > 1]:
            raise SelectionError(f"not constant within a sample: {', '.join(conflicts)}")
    return out.orderBy(first).select(F.col(f"`{sample}`"), *(F.col(f"`{c}`") for c in names))


def sample_summary(table: AxisTable, sample: str, *, obs: Any = None, x: Any = None, layer: str | None = None) -> DataFrame:
    return table.summarize(obs=obs, x=x, by=sample, layer=layer)


def add_sample_meta(table: AxisTable, meta: Any, *, sample: str, by: str | None = None, suffixes: tuple[str, str] = ("", "_meta")) -> AxisTable:
    meta = as_frame(table._obs.df, meta)
    key = by or sample
    if key not in meta.columns:
        raise UnknownColumnError(f"unknown column {key!r}")
    if key != sample:
        if sample in meta.columns:
            raise DuplicateNameError(f"{sample!r} exists already")
        meta = meta.withColumnRenamed(key, sample)
    return table.left_join(meta, by=sample, suffixes=suffixes)


@dataclass(frozen=True)
class FeaturePresence:
    """Which of the asked features there are, which are not, and which there are in other letter case."""

    found_features: list[str]
    missing_features: list[str]
    wrong_case_found_features: list[str]
    frame: DataFrame

    @property
    def all_found(self) -> bool:
        return not self.missing_features

    def to_frame(self) -> DataFrame:
        return self.frame


def feature_frame(table: AxisTable, features: Sequence[str], feature_column: str | None = None, case_check: bool = True) -> DataFrame:
    """(feature, found, wrong_case_found) for each asked feature, in order; the asked list is the small side."""
    var = table._var_axis()
    column = feature_column or var.name
    var.resolve(column)
    asked = var.df.sparkSession.createDataFrame(list(enumerate(features)), "k int, feature string")
    held = var.df.select(F.col(f"`{column}`").cast("string").alias("h"), F.col(var.order[0][0]).alias("o"))
    exact = held.select(F.col("h").alias("feature")).distinct().withColumn("found", F.lit(True))
    lower = held.groupBy(F.lower("h").alias("l")).agg(F.min_by("h", "o").alias("w"))
    out = asked.join(exact, "feature", "left").join(lower, F.lower("feature") == F.col("l"), "left")
    wrong = F.when(F.col("found").isNull(), F.col("w")) if case_check else F.lit(None).cast("string")
    return out.select("k", "feature", F.coalesce("found", F.lit(False)).alias("found"), wrong.alias("wrong_case_found")).orderBy("k").drop("k")


def feature_present(table: AxisTable, features: Sequence[str], *, feature_column: str | None = None, case_check: bool = True) -> FeaturePresence:
    frame = feature_frame(table, list(features), feature_column, case_check)
    rows = frame.collect()
    return FeaturePresence([r["feature"] for r in rows if r["found"]], [r["feature"] for r in rows if not r["found"]], [r["wrong_case_found"] for r in rows if r["wrong_case_found"] is not None], frame)


def _named(a, df: DataFrame, made) -> Any:
    """The axis with other names; rows that were in the order of the names stay where they are."""
    if a.name in [c for c, _ in a.order]:
        was = hidden("was")
        df, a = df.withColumn(was, F.col(f"`{a.name}`")), a.but(order=[(was if c == a.name else c, d) for c, d in a.order])
    return a.but(df=df.withColumn(a.name, made))


def _unique(table: AxisTable, axis: str, a) -> AxisTable:
    if table.validate == "eager" and not a.df.groupBy(F.col(f"`{a.name}`")).count().where("count > 1").isEmpty():
        raise DuplicateNameError("renaming makes equal names")
    return table._with_axis(axis, a)


def _rename_names(table: AxisTable, mapper: Callable[[str], str] | Mapping[str, str], axis: str) -> AxisTable:
    a = table._axis(axis)
    if a.name is None:
        raise SelectionError("the axis has no names")
    c = F.col(f"`{a.name}`")
    if callable(mapper):
        new_axis = _named(a, a.df, F.pandas_udf(lambda names: names.map(mapper, na_action="ignore"), "string")(c.cast("string")))
    else:
        rows = a.df.sparkSession.createDataFrame([(old, new) for new, old in mapper.items()], "old string, new string")
        old, new = hidden("old"), hidden("new")
        if len(set(mapper.values())) < len(mapper):
            raise DuplicateNameError("a name is renamed twice")
        if table.validate == "eager" and mapper:
            held = {r[0] for r in a.df.where(c.cast("string").isin(list(mapper.values()))).select(c.cast("string")).distinct().collect()}
            if missing := sorted(set(mapper.values()) - held):
                raise UnknownColumnError(f"unknown names: {', '.join(missing)}")
        new_axis = _named(a, a.df.join(rows.toDF(old, new), c.cast("string") == F.col(old), "left"), F.coalesce(F.col(new), c.cast("string")))
        new_axis = new_axis.but(df=new_axis.df.drop(old, new))
    return _unique(table, axis, new_axis)


def rename_obs_names(table: AxisTable, mapper) -> AxisTable:
    return _rename_names(table, mapper, OBS)


def rename_var_names(table: AxisTable, mapper) -> AxisTable:
    return _rename_names(table, mapper, VAR)


def _made_names(table: AxisTable, axis: Any, make) -> AxisTable:
    axis = axis_name(axis)
    a = table._axis(axis)
    if a.name is None:
        raise SelectionError("the axis has no names")
    return _unique(table, axis, _named(a, a.df, make(F.col(f"`{a.name}`").cast("string"))))


def replace_name_suffix(table: AxisTable, old: str, new: str, *, axis: Any = OBS) -> AxisTable:
    """Names that end in ``old`` end in ``new``; an empty ``old`` appends."""
    def make(c):
        if not old:
            return F.concat(c, F.lit(new))
        return F.when(F.endswith(c, F.lit(old)), F.concat(F.substr(c, F.lit(1), F.char_length(c) - len(old)), F.lit(new))).otherwise(c)

    return _made_names(table, axis, make)


def add_name_prefix(table: AxisTable, prefix: str, *, sep: str = "_", axis: Any = OBS) -> AxisTable:
    return _made_names(table, axis, lambda c: F.concat(F.lit(prefix + sep), c))


def name_duplicates(table: AxisTable, *, axis: Any = OBS, name: str | None = None) -> DataFrame:
    """(name, count, positions) of names that occur more than once, as first seen. Positions are gathered for those only.

    They are row numbers of the axis, which with the table's ``order_parts`` are found in ranges of its order.
    """
    axis = axis_name(axis)
    a = table._axis(axis)
    name = name or a.name
    at, key = hidden("p"), hidden("k")
    again = a.df.groupBy(F.col(f"`{name}`").alias(key)).agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    df = table._numbered(axis, at).df.select(F.col(f"`{name}`").alias("name"), at).join(again, F.col("name").eqNullSafe(F.col(key)), "left_semi")
    out = df.groupBy("name").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list(at)).alias("positions"))
    return out.orderBy(F.get("positions", 0))


def store_palette(table: AxisTable, obs: str, palette: Mapping[Any, str] | Sequence[str], *, levels: Sequence[Any] | None = None, key: str | None = None) -> AxisTable:
    """Colours of a column's levels, as a side table (level, ordinal, color). Levels are as first seen unless given."""
    a = table._obs
    a.resolve(obs)
    declared = a.df.schema[obs].metadata.get("levels") if levels is None else list(levels)
    if declared is None:
        ctx = a.context()
        first = ctx.df.where(F.col(f"`{obs}`").isNotNull()).groupBy(F.col(f"`{obs}`").alias("v")).agg(F.min(ctx.place()).alias("p"))
        declared = [r[0] for r in first.orderBy("p").select("v").collect()]
    if isinstance(palette, Mapping):
        if missing := [x for x in declared if x not in palette]:
            raise SizeMismatchError(f"levels without a colour: {missing}")
        colors = [palette[x] for x in declared]
    else:
        colors = list(palette)
        if len(colors) < len(declared):
            raise SizeMismatchError("there are fewer colours than levels")
    rows = [(str(x), k, c) for k, (x, c) in enumerate(zip(declared, colors, strict=False))]
    side = a.df.sparkSession.createDataFrame(rows, "level string, ordinal int, color string")
    return table._but(_uns={**table._uns, key or f"{obs}_colors": side})


def get_palette(table: AxisTable, obs: str, *, key: str | None = None) -> dict[str, str]:
    side = table.as_frame("uns", key=key or f"{obs}_colors")
    return {r["level"]: r["color"] for r in side.orderBy("ordinal").collect()}


def with_levels(df: DataFrame, column: str, levels: Sequence[Any], ordered: bool = False) -> DataFrame:
    """Declare a text column categorical: its levels are kept in the column's metadata."""
    return df.withMetadata(column, {"levels": list(levels), "ordered": ordered})


def numeric(kind: Any) -> bool:
    return S.is_numeric(kind)
