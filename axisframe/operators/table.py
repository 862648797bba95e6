"""The annotated matrix: a table of observations, a small table of features, and matrices aligned to both.

Observations are rows of one DataFrame that also holds every matrix aligned to them as an array (or struct, or wide)
column, so no verb can put them out of step. The order of rows is a list of columns, ending in ones that make it unique;
it is applied only where an operator reads it or a result is asked for in order. Features are rows of a second, small
DataFrame with their slots in the arrays. Nothing runs before an action, but for the checks and discoveries that say so.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..errors import DuplicateNameError, IncompatibleAxisError, NameRepairError, SelectionError, SizeMismatchError, UnknownColumnError, UnknownSourceError
from ..functions import expr as E
from ..functions import selectors as S
from ..plans.compiler import HIDDEN, MOST_JOINS, Context, crosses_rows, hidden, in_order
from ..sources.matrix import Matrix, check_budget
from . import joins, tidy

SLOT = HIDDEN + "slot"
OBS, VAR = "obs", "var"


def axis_name(axis: Any) -> str:
    if axis in ("obs", "observation", "observations", 0):
        return OBS
    if axis in ("var", "variable", "variables", 1):
        return VAR
    raise IncompatibleAxisError(f"unknown axis {axis!r}")


def _listed(x: Any) -> list[Any]:
    return [] if x is None else [x] if isinstance(x, (str, E.Expr, E.Desc, S.Selector, S.Across, S.Quantified)) else list(x)


class Axis:
    """One axis's frame, its public columns in order, the row order and the column that holds names."""

    def __init__(self, df: DataFrame, public: Sequence[str], order: Sequence[tuple[str, bool]] = (), name: str | None = None, parts: int | None = 1):
        self.df, self.public, self.order, self.name, self.parts = df, list(public), list(order), name, parts
        #: How many joins with aggregates of itself the frame is made of.
        self.joins = 0
        #: The frame before NaN became missing, as long as ``df`` is no more than that.
        self.raw: DataFrame | None = None
        #: Conditions that ``df`` has beyond that.
        self.kept: list[Column] = []

    def but(self, **new: Any) -> Axis:
        out = copy.copy(self)
        out.__dict__.update({"raw": None, **new} if "df" in new else new)  # another frame
        return out

    def types(self) -> dict[str, Any]:
        return {f.name: f.dataType for f in self.df.schema}

    def column(self, name: str) -> Column:
        if name in (E.OBS_NAMES, E.VAR_NAMES):
            if self.name is None:
                raise UnknownColumnError("the axis has no names")
            return F.col(f"`{self.name}`")
        if name not in self.public:
            raise UnknownColumnError(f"unknown column {name!r}")
        return F.col(f"`{name}`")

    def resolve(self, selection: Any) -> list[str]:
        return S.resolve(selection, self.public, self.types())

    def context(self, keys: Sequence[str] = (), resolve: Callable[[str], Column] | None = None, df: DataFrame | None = None) -> Context:
        return Context(self.df if df is None else df, resolve or self.column, keys, self.order, self.parts, self.joins)

    def shown(self, ordered: bool = False) -> DataFrame:
        df = self.df.orderBy(*in_order(self.order)) if ordered and self.order else self.df
        return df.select(*(F.col(f"`{c}`") for c in self.public))


class Verbs:
    """Verbs of the ungrouped and the grouped table."""

    _groups: tuple[str, tuple[str, ...]] | None = None

    # -- state --
    def _but(self, **new: Any):
        out = copy.copy(self)
        out.__dict__.update(new)
        return out

    def _axis(self, axis: str) -> Axis:
        return self._obs if axis == OBS else self._var_axis()

    def _with_axis(self, axis: str, new: Axis):
        return self._but(_obs=new) if axis == OBS else self._but(_var=new, _pairs=None)

    def _keys(self, axis: str) -> list[str]:
        return list(self._groups[1]) if self._groups and self._groups[0] == axis else []

    def _chosen(self, axis: Any) -> str:
        """The axis that is named, or else the grouped one, or observations."""
        return axis_name(axis) if axis is not None else self._groups[0] if self._groups else OBS

    def _only_group_axis(self, axis: str) -> None:
        if self._groups and self._groups[0] != axis:
            raise IncompatibleAxisError(f"the table is grouped on {self._groups[0]}")

    def _var_axis(self) -> Axis:
        if self._var is None:
            raise UnknownSourceError("the table has no features")
        return self._var

    def features(self) -> list[tuple[str, int]]:
        """(name, slot) of each feature in order; read once from the feature table, which is as long as a row is wide."""
        if self._pairs is None:
            if self._var is None:
                self._pairs = []
            else:
                var = self._var
                df = var.df.orderBy(*in_order(var.order)) if var.order else var.df
                self._pairs = [(r[0], int(r[1])) for r in df.select(F.col(f"`{var.name}`"), SLOT).collect()]
        return self._pairs

    def _matrix(self, source: str, key: str | None = None, layer: str | None = None) -> Matrix:
        if source == "x":
            held = self._matrices.get(("layer", layer) if layer is not None else ("x", None))
            if held is None:
                raise UnknownSourceError(f"unknown layer {layer!r}" if layer is not None else "the table has no matrix")
            return held.with_features(self.features())
        if source == "raw" and layer is not None:
            raise UnknownSourceError("raw has no layers")
        held = self._matrices.get((source, key))
        if held is None:
            raise UnknownSourceError(f"unknown {source} {'' if key is None else repr(key)}".strip())
        return held

    def _sources(self, obs=None, var=None, x=None, raw=None, obsm=None, varm=None, layer=None) -> list[tuple[str, Callable[[str], Column], list[str], dict, Any, int]]:
        """(axis, resolver, names, types, request, matrix?) of every source that is asked for, in the order of sources."""
        out = []
        if obs is not None:
            out.append((OBS, self._obs.column, self._obs.public, self._obs.types(), obs, None))
        if var is not None:
            v = self._var_axis()
            out.append((VAR, v.column, v.public, v.types(), var, None))
        for source, request in (("x", x), ("raw", raw)):
            if request is not None:
                m = self._matrix(source, layer=layer if source == "x" else None)
                out.append((OBS, m.column, list(m.names), _float_types(m), request, m))
        for source, axis, requests in (("obsm", OBS, obsm), ("varm", VAR, varm)):
            for key, request in (requests or {}).items():
                m = self._matrix(source, key)
                out.append((axis, m.column, list(m.names), _float_types(m), request, m))
        return out

    def _budget(self, sources, most: int | None) -> None:
        if most is None:
            return
        wide = []
        for *_, names, types, request, m in sources:
            if m is not None:
                asked = {n for e in _requested(request, names, types) for n in e.names()}
                wide.append(len(asked & set(names)))
        check_budget(self._obs.df, wide, most)

    # -- order --
    def _major(self, axis: str) -> Axis:
        """The axis with its order by group, groups as first seen."""
        a, keys = self._axis(axis), self._keys(axis)
        if not keys or not a.order:
            return a
        whole = a.context()
        place = F.min(whole.place())
        ctx = a.context(keys, df=whole.df)
        if a.joins < MOST_JOINS:
            ctx._joined(place)
            ctx.flush()
            first = ctx.made.pop()
        else:
            first = hidden("g")
            ctx.df = ctx.df.withColumn(first, place.over(Window.partitionBy(*ctx._groups())))
        return a.but(df=ctx.df.drop(*whole.made), order=[(first, False), *a.order], joins=ctx.joins)

    def _keep(self, axis: str, a: Axis, condition: Column):
        return self._with_axis(axis, a.but(df=a.df.where(condition)))

    # -- projection --
    def select(self, *, obs: Any = None, var: Any = None, x: Any = None):
        """Keep metadata columns; ``x`` keeps features, in the order asked for. Group keys stay, those left out first."""
        out = self
        for axis, request in ((OBS, obs), (VAR, var)):
            if request is not None:
                a = out._axis(axis)
                names = a.resolve(request)
                names = [k for k in out._keys(axis) if k not in names] + names
                out = out._with_axis(axis, a.but(public=names))
        if x is not None:
            pairs = self.features()
            chosen = S.resolve(x, [n for n, _ in pairs], _float_types(self._matrix("x")))
            left, slots = list(pairs), []
            for name in chosen:  # a repeated name takes its next occurrence
                hit = next((p for p in left if p[0] == name), None)
                if hit is None:
                    raise UnknownColumnError(f"unknown or repeated feature {name!r}")
                left.remove(hit)
                slots.append(hit[1])
            out = out._with_features(slots)
        return out

    def _with_features(self, slots: list[int]):
        var, at = self._var_axis(), hidden("at")
        rows = self._obs.df.sparkSession.createDataFrame(list(zip(slots, range(len(slots)), strict=True)), f"{SLOT} int, {at} int")
        return self._with_axis(VAR, var.but(df=var.df.join(F.broadcast(rows), SLOT), order=[(at, False)]))

    def rename(self, *, obs: Mapping[str, str] | None = None, var: Mapping[str, str] | None = None, x: Mapping[str, str] | None = None):
        """{new: old} for columns; ``x`` renames features."""
        out = self
        for axis, names in ((OBS, obs), (VAR, var)):
            if names:
                out = out._renamed(axis, dict(names))
        if x:
            out = out._rename_features(dict(x))
        return out

    def _renamed(self, axis: str, names: dict[str, str]):
        a = self._axis(axis)
        if len(set(names.values())) < len(names):
            raise DuplicateNameError("a column is renamed twice")
        if missing := [o for o in names.values() if o not in a.public]:
            raise UnknownColumnError(f"unknown columns: {', '.join(missing)}")
        new_of = {o: n for n, o in names.items()}
        public = [new_of.get(c, c) for c in a.public]
        if len(set(public)) < len(public):
            raise DuplicateNameError("renaming makes equal names")
        aside = {n: hidden("aside") for n in new_of.values() if n in a.df.columns and n not in new_of}  # columns not shown
        df = a.df.withColumnsRenamed(aside).withColumnsRenamed(new_of)
        new_of = {**new_of, **aside}
        out = self._with_axis(axis, a.but(df=df, public=public, order=[(new_of.get(c, c), d) for c, d in a.order], name=new_of.get(a.name, a.name)))
        if self._groups and self._groups[0] == axis:
            out._groups = (axis, tuple(new_of.get(k, k) for k in self._groups[1]))
        return out

    def _rename_features(self, names: dict[str, str]):
        held = [n for n, _ in self.features()]
        old = list(names.values())
        if len(set(old)) < len(old) or any(held.count(o) > 1 for o in old):
            raise DuplicateNameError("a feature's name is not unique")
        if missing := [o for o in old if o not in held]:
            raise UnknownColumnError(f"unknown features: {', '.join(missing)}")
        new_of = {o: n for n, o in names.items()}
        after = [new_of.get(n, n) for n in held]
        if len(set(after)) < len(set(held)):
            raise DuplicateNameError("renaming makes equal feature names")
        return self._mapped_names(VAR, new_of)

    def _mapped_names(self, axis: str, new_of: dict[str, str]):
        a = self._axis(axis)
        c = F.col(f"`{a.name}`")
        made = reduce(lambda w, kv: w.when(c == kv[0], F.lit(kv[1])), list(new_of.items())[1:], F.when(c == (first := next(iter(new_of.items())))[0], F.lit(first[1]))).otherwise(c) if new_of else c
        return self._with_axis(axis, a.but(df=a.df.withColumn(a.name, made)))

    def rename_with(self, func: Callable[[str], str], *, obs: Any = None, var: Any = None, x: Any = None):
        out = self
        for axis, request in ((OBS, obs), (VAR, var)):
            if request is not None:
                names = out._axis(axis).resolve(request)
                new = {c: func(c) for c in names}
                if len(set(new.values())) < len(new):
                    raise DuplicateNameError("rename_with makes equal names")
                out = out._renamed(axis, {n: o for o, n in new.items() if n != o})
        if x is not None:
            names = S.resolve(x, [n for n, _ in self.features()], _float_types(self._matrix("x")))
            out = out._rename_features({func(n): n for n in names})
        return out

    def relocate(self, *, obs: Any = None, var: Any = None, x: Any = None, before: str | None = None, after: str | None = None):
        """Move columns (or features) to the front, or beside an anchor."""
        out = self
        for axis, request in ((OBS, obs), (VAR, var)):
            if request is not None:
                a = out._axis(axis)
                out = out._with_axis(axis, a.but(public=_moved(a.public, a.resolve(request), before, after)))
        if x is not None:
            pairs = self.features()
            names = [n for n, _ in pairs]
            chosen = S.resolve(x, names, _float_types(self._matrix("x")))
            for anchor in (before, after):
                if anchor is not None and names.count(anchor) > 1:
                    raise DuplicateNameError(f"the anchor {anchor!r} is not unique")
            places = _moved(list(range(len(names))), [names.index(c) for c in chosen], *(None if y is None else _index(names, y) for y in (before, after)))
            out = out._with_features([pairs[k][1] for k in places])
        return out

    # -- rows --
    def filter(self, *, obs: Any = None, var: Any = None, x: Any = None, raw: Any = None, obs_names: Any = None, var_names: Any = None, obsm: Mapping | None = None, varm: Mapping | None = None, layer: str | None = None, max_matrix_values: int | None = None):
        """Rows for which every predicate holds. Aggregates and row numbers are the group's, or the whole axis's."""
        sources = self._sources(obs, var, x, raw, obsm, varm, layer)
        for axis, request in ((OBS, obs_names), (VAR, var_names)):
            if request is not None:
                a = self._axis(axis)
                name = E.OBS_NAMES if axis == OBS else E.VAR_NAMES
                request = request if isinstance(request, E.Expr) else E.col(name).is_in([request] if isinstance(request, str) else request)
                sources.append((axis, a.column, a.public, a.types(), request, None))
        self._budget(sources, max_matrix_values)
        out = self
        for axis in (OBS, VAR):
            mine = [s for s in sources if s[0] == axis]
            if not mine:
                continue
            self._only_group_axis(axis)
            a = self._axis(axis)
            scanned = None
            every = [p for s in mine for p in _predicates(s[4], s[2], s[3])]
            if a.raw is not None and not self._keys(axis) and not any(map(crosses_rows, every)):  # aggregates are of all rows
                # what the scan itself can take goes below the step that makes NaN missing; it drops no row that passes
                held = Context(a.raw, lambda n: F.col(f"`{n}`"))
                early = [held.column(p) for s in mine if s[5] is None for p in _predicates(s[4], s[2], s[3]) if p.plain and p.names() <= set(a.public)]
                scanned = reduce(DataFrame.where, early, a.raw)
                a = a.but(df=reduce(DataFrame.where, a.kept, tidy.nan_to_null(scanned)))
            ctx = a.context(self._keys(axis))
            plain, staged = [], []
            for _, resolve, names, types, request, _ in mine:
                ctx.resolve = resolve
                for p in _predicates(request, names, types):
                    (staged if crosses_rows(p) else plain).append(ctx.temp(ctx.column(p)) if crosses_rows(p) else ctx.column(p))
            ctx.flush()
            condition = reduce(lambda c, d: c & d, [*plain, *staged])
            new = a.but(df=ctx.df.where(condition).drop(*ctx.made), joins=ctx.joins)
            if scanned is not None and not ctx.made:
                new.raw, new.kept = scanned, [*a.kept, condition]
            out = out._with_axis(axis, new)
            out = out._with_axis(axis, out._major(axis))
        return out

    def distinct(self, *, obs: Any = None, var: Any = None, x: Any = None, axis: Any = None, keep_all: bool = True):
        """The first row of each tuple of the selected columns (of all metadata, if none is selected)."""
        given = [(k, v) for k, v in ((OBS, obs), (VAR, var), ("x", x)) if v is not None]
        if len(given) > 1:
            raise IncompatibleAxisError("distinct takes one source at a time")
        source, request = given[0] if given else (self._chosen(axis), S.everything())
        axis = OBS if source == "x" else source
        self._only_group_axis(axis)
        a = self._major(axis)
        keys = self._keys(axis)
        if source == "x":
            m = self._matrix("x")
            columns = [m.column(n) for n in S.resolve(request, list(m.names), _float_types(m))]
        else:
            names = a.resolve(request)
            columns = [F.col(f"`{n}`") for n in names]
        at = hidden("d")
        window = Window.partitionBy(*(F.col(f"`{k}`") for k in keys), *columns).orderBy(*(in_order(a.order) or columns))
        df = a.df.withColumn(at, F.row_number().over(window)).where(F.col(at) == 1).drop(at)
        public = a.public if keep_all or source == "x" else [*(k for k in keys if k not in names), *names]
        return self._with_axis(axis, a.but(df=df, public=public))

    def _numbered(self, axis: str, at: str) -> Axis:
        a = self._major(axis)
        ctx = a.context(self._keys(axis))
        place = ctx.column(E.row_number())
        return a.but(df=ctx.df.withColumn(at, place - 1).drop(*ctx.made))

    def slice(self, *indices: Any, axis: Any = None):
        """Rows by position: ints, lists, slices or a boolean mask; order and repeats are kept, negatives count from the end.

        A single slice is a condition on positions and a mask that is an expression a filter, whatever their lengths; lists are
        as long as the caller made them and meet the rows in a join.
        """
        axis = self._chosen(axis)
        self._only_group_axis(axis)
        if len(indices) == 1 and isinstance(indices[0], E.Expr):
            return self.filter(**{axis: indices[0]})
        at, want, size = hidden("p"), hidden("o"), hidden("n")
        a, keys = self._numbered(axis, at), self._keys(axis)
        one = indices[0] if len(indices) == 1 and isinstance(indices[0], slice) and (indices[0].step or 1) > 0 else None
        bounds = [] if one is None else [x for x in (one.start, one.stop) if x is not None]
        df, total = a.df, None
        if one is None:
            total = None if keys else df.count()
            places = _positions(indices, total)
            if total is not None:
                places = [p + total if p < 0 else p for p in places]
        if any(x < 0 for x in (places if one is None else bounds)):
            ctx = a.context(keys)
            n = ctx.column(E.n())
            ctx.flush()
            df = ctx.df.withColumn(size, n).drop(*ctx.made)
        if one is not None:
            place = lambda x: F.lit(x) if x >= 0 else F.greatest(F.col(size) + x, F.lit(0))
            first = F.lit(0) if one.start is None else place(one.start)
            keep = [F.col(at) >= first]
            if one.stop is not None:
                keep.append(F.col(at) < place(one.stop))
            if (one.step or 1) > 1:
                keep.append((F.col(at) - first) % one.step == 0)
            return self._with_axis(axis, a.but(df=df.where(reduce(lambda c, d: c & d, keep)).drop(at, size)))
        order = [*(a.order[:1] if keys else []), (want, False), *a.order]
        if not places:
            return self._with_axis(axis, a.but(df=df.where(F.lit(False)).withColumn(want, F.lit(0).cast("long")).drop(at, size), order=order))
        rows = a.df.sparkSession.createDataFrame(list(zip(places, range(len(places)), strict=True)), f"{want}_p long, {want} long")
        ends = [F.col(at).cast("long")] if max(places) >= 0 else []
        ends += [(F.col(at) - F.col(size)).cast("long")] if min(places) < 0 else []
        key = hidden("e")  # a position from the front, from the back (below 0), or both
        df = df.withColumn(key, F.explode(F.array(*ends)) if len(ends) > 1 else ends[0])
        # Spark knows the size of the caller's list and broadcasts it only while it is small
        df = df.join(rows, F.col(key) == F.col(f"{want}_p"))
        return self._with_axis(axis, a.but(df=df.drop(at, size, key, f"{want}_p"), order=order))

    def _ends(self, n: int, axis: Any, order: Callable[[Axis], list[Column]], forward: bool = True, extra: Callable[[Axis], Axis] = lambda a: a):
        if n < 0:
            raise SelectionError("n is at least 0")
        axis = self._chosen(axis)
        self._only_group_axis(axis)
        a = extra(self._major(axis))
        if not a.order:
            raise SelectionError("slices read the order of rows: give the table an order_by")
        if keys := self._keys(axis):
            at = hidden("p")
            df = a.df.withColumn(at, F.row_number().over(Window.partitionBy(*(F.col(f"`{k}`") for k in keys)).orderBy(*order(a)))).where(F.col(at) <= n).drop(at)
        else:
            df = a.df.orderBy(*order(a)).limit(n)
        return self._with_axis(axis, a.but(df=df))

    def slice_head(self, n: int = 5, *, axis: Any = None):
        return self._ends(n, axis, lambda a: in_order(a.order))

    def slice_tail(self, n: int = 5, *, axis: Any = None):
        backward = lambda a: [F.col(f"`{c}`").asc_nulls_first() if down else F.col(f"`{c}`").desc_nulls_first() for c, down in a.order]
        return self._ends(n, axis, backward)

    def _extreme(self, by: Any, n: int, axis: Any, largest: bool):
        axis_ = self._chosen(axis)

        def keyed(a: Axis) -> Axis:
            ctx = a.context(self._keys(axis_))
            new = []
            for k in _listed(by):
                e, down = (k.expr, not largest) if isinstance(k, E.Desc) else (E.column_of(k), largest)
                ctx.temp(ctx.column(e), "k")
                new.append((ctx.made.pop(), down))
            lead = a.order[:1] if self._keys(axis_) else []
            return a.but(df=ctx.df.drop(*ctx.made), order=[*lead, *new, *a.order[len(lead):]])

        return self._ends(n, axis, lambda a: in_order(a.order), extra=keyed)

    def slice_min(self, by: Any, n: int = 5, *, axis: Any = None):
        """The n rows that sort first; no ties beyond n, missing last."""
        return self._extreme(by, n, axis, False)

    def slice_max(self, by: Any, n: int = 5, *, axis: Any = None):
        return self._extreme(by, n, axis, True)

    def slice_sample(self, n: int | None = None, *, prop: float | None = None, replace: bool = False, random_state: int | None = None, axis: Any = None):
        """A seeded random sample, of each group if grouped; draws with ``replace`` repeat rows."""
        axis = self._chosen(axis)
        self._only_group_axis(axis)
        if n is not None and prop is not None:
            raise SelectionError("slice_sample takes n or prop")
        if (n is not None and n < 0) or (prop is not None and prop < 0):
            raise SelectionError("a sample's size is at least 0")
        a, keys = self._axis(axis), self._keys(axis)
        seed = 0 if random_state is None else int(random_state)
        groups = [F.col(f"`{k}`") for k in keys]
        size, at, draw = hidden("n"), hidden("p"), hidden("draw")
        sizes = a.df.groupBy(*groups).agg(F.count(F.lit(1)).alias(size))
        want = F.bround(F.col(size) * F.lit(float(prop))).cast("long") if prop is not None else F.lit(n) if n is not None else F.least(F.col(size), F.lit(1))
        if not replace and n is not None and not sizes.where(F.col(size) < n).isEmpty():
            raise SelectionError("a sample without replacement is larger than its rows")
        spread = F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c, _ in a.order)) if a.order else F.rand(seed)
        if not keys and not replace and prop is None:  # a top-n
            return self._with_axis(axis, a.but(df=a.df.orderBy(spread, *in_order(a.order)).limit(1 if n is None else n)))
        place = Window.partitionBy(*groups).orderBy(spread, *in_order(a.order))
        df = a.df.withColumn(at, F.row_number().over(place))
        ctx = a.but(df=df).context(keys)
        total = ctx.column(E.n())
        ctx.flush()
        df = ctx.df.withColumn(size, total).drop(*ctx.made)
        if not replace:
            df = df.where(F.col(at) <= want).drop(at, size)
            return self._with_axis(axis, self._with_axis(axis, a.but(df=df))._major(axis))
        draws = sizes.select(*groups, size, F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(want, F.lit(0)).cast("long"))).alias(draw)).where(F.col(draw) <= want)
        draws = draws.select(*(F.col(f"`{k}`").alias(f"{draw}_{i}") for i, k in enumerate(keys)), (F.pmod(F.xxhash64(F.lit(seed), F.col(draw), *groups), F.col(size)) + 1).alias(f"{draw}_p"), draw)
        on = F.col(at) == F.col(f"{draw}_p")
        for i, k in enumerate(keys):
            on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"{draw}_{i}"))
        df = df.join(draws, on).drop(at, size, f"{draw}_p", *(f"{draw}_{i}" for i in range(len(keys))))
        return self._with_axis(axis, self._with_axis(axis, a.but(df=df, order=[*a.order, (draw, False)]))._major(axis))

    def arrange(self, *, obs: Any = None, var: Any = None, x: Any = None, raw: Any = None, obsm: Mapping | None = None, varm: Mapping | None = None, layer: str | None = None, max_matrix_values: int | None = None):
        """A stable order by keys of all sources, missing last; within groups if grouped. No rows move before a result is read."""
        sources = self._sources(obs, var, x, raw, obsm, varm, layer)
        self._budget(sources, max_matrix_values)
        out = self
        for axis in (OBS, VAR):
            mine = [s for s in sources if s[0] == axis]
            if not mine:
                continue
            self._only_group_axis(axis)
            a = self._major(axis)
            ctx, new = a.context(self._keys(axis)), []
            for _, resolve, names, types, request, _ in mine:
                ctx.resolve = resolve
                for k in _listed(request):
                    for e, down in _sort_keys(k, names, types):
                        if e.kind == "column" and resolve == a.column and e.name in a.public:
                            copy_of = hidden("k")  # the key stays as it is now if the column is changed later
                            ctx.df = ctx.df.withColumn(copy_of, F.col(f"`{e.name}`"))
                        else:
                            ctx.temp(ctx.column(e), "k")
                            copy_of = ctx.made.pop()
                        new.append((copy_of, down))
            ctx.flush()
            lead = a.order[:1] if self._keys(axis) and a.order else []
            out = out._with_axis(axis, a.but(df=ctx.df.drop(*ctx.made), order=[*lead, *new, *a.order[len(lead):]]))
        return out

    # -- columns --
    def mutate(self, *, obs: Any = None, var: Any = None, x: Any = None, raw: Any = None, obsm: Mapping | None = None, varm: Mapping | None = None, layer: str | None = None, max_matrix_values: int | None = None):
        """New columns. Within a source each sees those before it; sources don't see each other's. Rows keep their order."""
        return self._mutate(self._sources(obs, var, x, raw, obsm, varm, layer), max_matrix_values)[0]

    def _mutate(self, sources, most):
        self._budget(sources, most)
        out, assigned = self, {OBS: [], VAR: []}
        for axis in (OBS, VAR):
            mine = [s for s in sources if s[0] == axis]
            if not mine:
                continue
            self._only_group_axis(axis)
            a, keys = self._axis(axis), self._keys(axis)
            ctx = a.context(keys)
            requests = [(s, _assignments(s[4], s[2], s[3])) for s in mine]
            sorts = any(x.kind in ("ordered", "ranked") for _, pairs in requests for e in pairs.values() for x in e.walk())
            every = [n for _, pairs in requests for n in pairs]
            frozen = {c: hidden("was") for c in {*keys, *(o for o, _ in a.order)} & set(every)}
            for c, held in frozen.items():  # this call's groups and order are those before it
                ctx.df = ctx.df.withColumn(held, F.col(f"`{c}`"))
            ctx.keys = [frozen.get(k, k) for k in keys]
            if sorts:
                ctx.sorted_by.add(tuple(ctx.keys))
            ctx.order = [(frozen.get(c, c), d) for c, d in a.order]
            final: dict[str, Column] = {}
            for (_, resolve, _, types, _, _), pairs in requests:
                here: dict[str, str] = {}
                ctx.resolve = lambda n, r=resolve, h=here: F.col(h[n]) if n in h else r(n)
                batch: dict[str, Column] = {}

                def settle(batch=batch, here=here, ctx=ctx) -> None:
                    ctx.flush()
                    if batch:
                        ctx.df = ctx.df.withColumns({here[k]: c for k, c in batch.items()})
                        batch.clear()

                for name, e in pairs.items():
                    if e.names() & set(batch) or name in batch or (batch and any(x.kind in ("ordered", "ranked", "partition") for x in e.walk())):
                        settle()
                    value = ctx.column(e)
                    here[name] = hidden("new")
                    batch[name] = value
                settle()
                for name, held in here.items():
                    final[name] = F.col(held)
                    ctx.made.append(held)
            df = ctx.df.withColumns(final).drop(*ctx.made)
            public = a.public + [n for n in dict.fromkeys(every) if n not in a.public]
            assigned[axis] = list(dict.fromkeys(every))
            out = out._with_axis(axis, a.but(df=df, public=public, order=ctx.order, joins=ctx.joins))
        return out, assigned

    def transmute(self, *, obs: Any = None, var: Any = None, x: Any = None, raw: Any = None, obsm: Mapping | None = None, varm: Mapping | None = None, layer: str | None = None, max_matrix_values: int | None = None):
        """mutate, then only the assigned columns (and group keys, first) on each axis that had assignments."""
        out, assigned = self._mutate(self._sources(obs, var, x, raw, obsm, varm, layer), max_matrix_values)
        for axis, names in assigned.items():
            if names:
                out = out._with_axis(axis, out._axis(axis).but(public=[*(k for k in self._keys(axis) if k not in names), *names]))
        return out

    # -- summaries --
    def _summary(self, axis: str, keys: list[str], ctx: Context, calls: list[Column], a: Axis, lead: Sequence[Column] = ()) -> DataFrame:
        """One row for each key in the order of ``lead``, then as first seen."""
        first = hidden("first")
        calls = list(calls)
        if keys and a.order:
            calls.append(F.min(ctx.place()).alias(first))
        ctx.flush()
        if not keys:
            return ctx.df.agg(*calls)
        out = ctx.df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(*calls)
        if a.order:
            return out.orderBy(*lead, first).drop(first)
        return out.orderBy(*lead) if lead else out

    def _by(self, axis: str, by: Any, ctx: Context, a: Axis) -> list[tuple[str, str]]:
        """(shown name, column of ctx.df) of each key; computed keys become columns."""
        out: list[tuple[str, str]] = []
        pairs = by.items() if isinstance(by, Mapping) else [(None, b) for b in _listed(by)]
        for name, b in pairs:
            e = b if isinstance(b, E.Expr) else None
            if e is not None and e.kind != "column":
                shown = name or e.label
                if not shown:
                    raise SelectionError("a computed key needs a name")
                if shown in a.public:
                    raise DuplicateNameError(f"the key {shown!r} would replace a column")
                ctx.temp(ctx.column(e), "by")
                out.append((shown, ctx.made[-1]))
            else:
                found = a.resolve(b)
                out += [(name or c, c) for c in found]
        if len({n for n, _ in out}) < len(out):
            raise DuplicateNameError("a key is named twice")
        return out

    def summarize(self, *, obs: Any = None, var: Any = None, x: Any = None, raw: Any = None, obsm: Mapping | None = None, varm: Mapping | None = None, by: Any = None, layer: str | None = None, max_matrix_values: int | None = None) -> DataFrame:
        """One row for each key, as first seen: a single grouped aggregate over all sources. Without a source, the count n."""
        sources = self._sources(obs, var, x, raw, obsm, varm, layer)
        axes = {s[0] for s in sources}
        if len(axes) > 1:
            raise IncompatibleAxisError("summarize takes sources of one axis")
        axis = axes.pop() if axes else self._groups[0] if self._groups else OBS
        self._only_group_axis(axis)
        self._budget(sources, max_matrix_values)
        a = self._axis(axis)
        ctx = a.context()
        if self._groups and by is not None:
            raise SelectionError("a grouped table summarizes by its groups")
        keys = [(k, k) for k in self._keys(axis)] or self._by(axis, by, ctx, a)
        ctx.keys = [c for _, c in keys]
        names, calls = [n for n, _ in keys], []
        for _, resolve, known, types, request, _ in sources:
            ctx.resolve = resolve
            for name, e in _assignments(request, known, types).items():
                if name in names:
                    raise DuplicateNameError(f"{name!r} is made twice")
                names.append(name)
                calls.append((name, ctx.summary(e)))
        if not sources:
            names.append("n")
            calls.append(("n", F.count(F.lit(1))))
        held = {n: hidden("s") for n, _ in calls}
        out = self._summary(axis, ctx.keys, ctx, [c.alias(held[n]) for n, c in calls], a)
        return out.select(*(F.col(f"`{c}`").alias(n) for n, c in keys), *(F.col(held[n]).alias(n) for n, _ in calls))

    summarise = summarize

    def _counted(self, axis: str, keys: Any, wt: Any, name: str, sort: bool = False) -> DataFrame:
        a = self._axis(axis)
        ctx = a.context()
        pairs = self._by(axis, keys, ctx, a)
        if name in [n for n, _ in pairs]:
            raise DuplicateNameError(f"{name!r} is a key")
        ctx.keys = [c for _, c in pairs]
        held = hidden("n")
        call = F.count(F.lit(1)) if wt is None else F.coalesce(F.sum(ctx._plain(E.column_of(wt))), F.lit(0))
        out = self._summary(axis, ctx.keys, ctx, [call.alias(held)], a, [F.col(held).desc_nulls_last()] if sort else ())
        return out.select(*(F.col(f"`{c}`").alias(n) for n, c in pairs), F.col(held).alias(name))

    def _count(self, by: Any, wt: Any, sort: bool, axis: Any, name: str) -> DataFrame:
        axis = axis_name(axis)
        return self._counted(axis, by, wt, name, sort)

    def _add_count(self, by: Any, wt: Any, sort: bool, axis: Any, name: str):
        axis = axis_name(axis)
        a = self._axis(axis)
        ctx = a.context()
        ctx.keys = [c for _, c in self._by(axis, by, ctx, a)]
        e = E.n() if wt is None else E.sum(wt)
        value = ctx.column(e)
        ctx.flush()
        df = ctx.df.withColumn(name, value).drop(*ctx.made)
        a = a.but(df=df, public=a.public + ([] if name in a.public else [name]), joins=ctx.joins)
        if sort:
            key = hidden("k")
            a = a.but(df=a.df.withColumn(key, F.col(f"`{name}`")), order=[(key, True), *a.order])
        return self._with_axis(axis, a)

    # -- joins --
    def _join(self, other, how: str, axis: Any, validate: str | None = None, **policy):
        axis = axis_name(axis)
        a = self._axis(axis)
        policy["right_order"] = [policy["right_order"]] if isinstance(policy.get("right_order"), str) else list(policy.get("right_order") or ())
        right, own = joins.placed(a.df, other, policy["right_order"])
        df, public, renamed = joins.enrich(a.df, a.public, right, how, validate=validate or self.validate, own_order=own, **policy)
        order = [(renamed.get(c, c), d) for c, d in a.order]
        if how == "right":
            order = own + order
        out = self._with_axis(axis, a.but(df=df, public=public, order=order, name=renamed.get(a.name, a.name)))
        if self._groups and self._groups[0] == axis:
            out._groups = (axis, tuple(renamed.get(k, k) for k in self._groups[1]))
        return out

    def left_join(self, other, *, by=None, axis: Any = OBS, **policy):
        return self._join(other, "left", axis, by=by, **policy)

    def inner_join(self, other, *, by=None, axis: Any = OBS, **policy):
        return self._join(other, "inner", axis, by=by, **policy)

    def right_join(self, other, *, by=None, axis: Any = OBS, **policy):
        """In the order of the right table: an AxisTable's or a mapping's own, or ``right_order`` of a DataFrame, which has none."""
        return self._join(other, "right", axis, by=by, **{"unmatched": "error", **policy})

    def full_join(self, other, *, by=None, axis: Any = OBS, **policy):
        return self._join(other, "full", axis, by=by, **{"unmatched": "error", **policy})

    def semi_join(self, other, *, by=None, axis: Any = OBS, na_matches: str = "na"):
        axis = axis_name(axis)
        a = self._axis(axis)
        return self._with_axis(axis, a.but(df=joins.only(a.df, a.public, joins.placed(a.df, other)[0], "semi", by=by, na_matches=na_matches)))

    def anti_join(self, other, *, by=None, axis: Any = OBS, na_matches: str = "na"):
        axis = axis_name(axis)
        a = self._axis(axis)
        return self._with_axis(axis, a.but(df=joins.only(a.df, a.public, joins.placed(a.df, other)[0], "anti", by=by, na_matches=na_matches)))

    def pipe(self, func: Any, *args: Any, **kwargs: Any) -> Any:
        if isinstance(func, tuple):
            func, name = func
            if name in kwargs:
                raise ValueError(f"{name!r} is both the table's argument and a keyword")
            return func(*args, **{name: self}, **kwargs)
        return func(self, *args, **kwargs)

    # -- frames --
    def obs_frame(self, ordered: bool = False) -> DataFrame:
        return self._obs.shown(ordered)

    def var_frame(self, ordered: bool = False) -> DataFrame:
        return self._var_axis().shown(ordered)


class GroupedAxisTable(Verbs):
    """A table whose verbs act within groups of one axis, until ``ungroup``."""

    def __init__(self, table: Verbs, axis: str, keys: Sequence[str]):
        self.__dict__.update(table.__dict__)
        self._groups = (axis, tuple(keys))

    def ungroup(self) -> AxisTable:
        out = AxisTable.__new__(AxisTable)
        out.__dict__.update({k: v for k, v in self.__dict__.items() if k != "_groups"})
        return out

    def group_vars(self) -> list[str]:
        return list(self._groups[1])

    def group_keys(self) -> DataFrame:
        return self._counted(self._groups[0], list(self._groups[1]), None, hidden("n")).select(*(F.col(f"`{k}`") for k in self._groups[1]))

    def group_data(self) -> DataFrame:
        """Keys and the positions (from 0) of each group's rows, in .rows."""
        axis, keys = self._groups
        at = hidden("p")
        df = self.ungroup()._numbered(axis, at).df
        out = df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.array_sort(F.collect_list(at)).alias(".rows"))
        return out.orderBy(F.get("`.rows`", 0))

    def __iter__(self) -> Iterable[tuple[dict[str, Any], AxisTable]]:
        """(key, subset) of each group; the keys are collected, the subsets are filters."""
        axis, keys = self._groups
        for row in self.group_keys().collect():
            key = row.asDict()
            a = self._axis(axis)
            on = reduce(lambda p, q: p & q, (F.col(f"`{k}`").eqNullSafe(F.lit(v)) for k, v in key.items()))
            yield key, self.ungroup()._keep(axis, a, on)

    def count(self, *, wt: Any = None, sort: bool = False, name: str = "n") -> DataFrame:
        return self._count(list(self._groups[1]), wt, sort, self._groups[0], name)

    tally = count

    def add_count(self, *, wt: Any = None, sort: bool = False, name: str = "n"):
        return self._add_count(list(self._groups[1]), wt, sort, self._groups[0], name)

    add_tally = add_count


class AxisTable(Verbs):
    """See the module's docstring."""

    def __init__(self, obs: DataFrame, *, order_by: str | Sequence[str] | None = None, x: Any = None, layers: Mapping[str, Any] | None = None, features: Sequence[str] | None = None, var: DataFrame | None = None, var_name: str | None = None, var_order_by: str | Sequence[str] | None = None, raw: Any = None, raw_features: Sequence[str] | None = None, obsm: Mapping[str, Any] | None = None, varm: Mapping[str, str] | None = None, obsp: Mapping[str, DataFrame] | None = None, varp: Mapping[str, DataFrame] | None = None, uns: Mapping[str, Any] | None = None, obs_name: str | None = None, layout: str = "dense_array", nan: str = "null", validate: str = "eager", order_parts: int | None = None):
        """``x``, ``layers``, ``raw``, ``obsm`` name columns of ``obs`` (with layout wide, lists of columns); ``varm`` of ``var``.

        Features are named by ``features``, or by ``var``'s column ``var_name`` in the order of ``var_order_by``, or f0, f1, ...

        Row numbers, running aggregates, lags, rolling functions and ranks of the ungrouped table run in ranges of its order
        (ranks: of the values), at the cost of small jobs that find the ranges and their totals as the verb is called: as many
        as its rows need, or ``order_parts``; with 1, or fewer rows than a range has, in one task.
        """
        before_nan = obs
        obs = tidy.nan_to_null(obs) if nan == "null" else obs
        self.validate, self._pairs = validate, None
        self._matrices: dict[tuple[str, str | None], Matrix] = {}
        taken: list[str] = []

        def matrix(columns: Any, kind: str, names: Sequence[str] = ()) -> Matrix:
            nonlocal obs
            columns = [columns] if isinstance(columns, str) else list(columns)
            if missing := [c for c in columns if c not in obs.columns]:
                raise UnknownColumnError(f"unknown columns: {', '.join(missing)}")
            taken.extend(columns)
            return Matrix(tuple(columns), kind, tuple(names), tuple(range(len(names))))

        self._obsp, self._varp, self._uns = dict(obsp or {}), dict(varp or {}), dict(uns or {})
        if x is not None:
            self._matrices[("x", None)] = matrix(x, layout)
        for name, columns in (layers or {}).items():
            self._matrices[("layer", name)] = matrix(columns, layout)
        if raw is not None:
            self._matrices[("raw", None)] = matrix(raw, layout, raw_features if raw_features is not None else _default_names(obs, raw, layout))
        for key, columns in (obsm or {}).items():
            if isinstance(columns, tuple):  # (column, names of its places)
                columns, names = columns
            else:
                names = [str(k) for k in range(_width(obs, columns, "dense_array"))]
            self._matrices[("obsm", key)] = matrix(columns, "dense_array", names)
        # hidden names: a new metadata column can never overwrite a matrix
        aside = {c: hidden("m") for c in dict.fromkeys(taken)}
        obs, before_nan = obs.withColumnsRenamed(aside), before_nan.withColumnsRenamed(aside)
        for k, m in self._matrices.items():
            self._matrices[k] = Matrix(tuple(aside[c] for c in m.columns), m.layout, m.names, m.slots)
        order = [order_by] if isinstance(order_by, str) else list(order_by or [])
        public = [c for c in obs.columns if not c.startswith(HIDDEN)]
        if missing := [c for c in order if c not in public]:
            raise UnknownColumnError(f"unknown columns: {', '.join(missing)}")
        # order keys are copies, so that a changed column doesn't change the order
        self._obs = Axis(obs, public, [(c, False) for c in order], obs_name, order_parts)
        self._obs.raw = before_nan if nan == "null" else None
        self._var = None
        spark = obs.sparkSession
        if var is not None:
            name = var_name or var.columns[0]
            names = [var_order_by] if isinstance(var_order_by, str) else list(var_order_by or [name])
            var = var.withColumn(SLOT, F.row_number().over(Window.orderBy(*(F.col(f"`{c}`").asc_nulls_last() for c in names))) - 1)
            held = {}
            for key, column in (varm or {}).items():
                held[column] = hidden("m")
                width = _width(var, column, "dense_array")
                self._matrices[("varm", key)] = Matrix((held[column],), "dense_array", tuple(map(str, range(width))), tuple(range(width)))
            var = var.withColumnsRenamed(held)
            self._var = Axis(var, [c for c in var.columns if not c.startswith(HIDDEN)], [(SLOT, False)], name)
        elif x is not None:
            names = list(features) if features is not None else _default_names(self._obs.df, x if layout == "wide" else self._matrices[("x", None)].columns, layout)
            var = spark.createDataFrame([(str(n), k) for k, n in enumerate(names)], f"var_name string, {SLOT} int")
            self._var = Axis(var, ["var_name"], [(SLOT, False)], "var_name")
            self._pairs = [(str(n), k) for k, n in enumerate(names)]

    @classmethod
    def from_dataframe(cls, df: DataFrame, **how: Any) -> AxisTable:
        return cls(df, **how)

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, **how: Any) -> AxisTable:
        return cls(spark.read.parquet(path), **how)

    @classmethod
    def from_format(cls, spark: SparkSession, kind: str, path: str, options: Mapping[str, str] | None = None, schema: Any = None, **how: Any) -> AxisTable:
        """Any format that Spark reads (parquet, orc, json, csv, ...)."""
        reader = spark.read.format(kind).options(**(options or {}))
        return cls((reader.schema(schema) if schema is not None else reader).load(path), **how)

    def write_parquet(self, path: str, mode: str = "error", partition_by: Sequence[str] = ()) -> None:
        """The whole table under a folder: obs with its matrices under stable names, var, obsp, varp, uns and a description.

        ``read_parquet`` reads it back; path/obs alone is a plain table, too.
        """
        spark, a = self._obs.df.sparkSession, self._obs
        text = lambda k: "__".join(str(p) for p in k if p is not None)
        said: dict[str, Any] = {"obs": a.public, "obs_name": a.name, "order": [d for _, d in a.order], "matrices": [], "validate": self.validate, "pairs": {}, "uns": {}}
        held = {OBS: [F.col(f"`{c}`") for c in a.public], VAR: []}
        for k, m in self._matrices.items():
            axis = VAR if k[0] == "varm" else OBS
            names = [f"matrix__{text(k)}" + (f"__{i}" if m.layout == "wide" else "") for i in range(len(m.columns))]
            held[axis] += [F.col(f"`{c}`").alias(n) for c, n in zip(m.columns, names, strict=True)]
            said["matrices"].append([list(k), names, m.layout, list(m.names), list(m.slots)])
        held[OBS] += [F.col(f"`{c}`").alias(f"order__{i}") for i, (c, _) in enumerate(a.order)]
        a.df.select(*held[OBS]).write.mode(mode).partitionBy(*partition_by).parquet(f"{path}/obs")
        if self._var is not None:
            v = self._var
            said |= {"var": v.public, "var_name": v.name, "var_order": [d for _, d in v.order]}
            lead = [F.col(f"`{c}`") for c in v.public] + [F.col(SLOT).alias("slot")]
            v.df.select(*lead, *held[VAR], *(F.col(f"`{c}`").alias(f"order__{i}") for i, (c, _) in enumerate(v.order))).write.mode(mode).parquet(f"{path}/var")
        for side, frames in (("obsp", self._obsp), ("varp", self._varp), ("uns", self._uns)):
            for i, (key, value) in enumerate(frames.items()):
                if isinstance(value, DataFrame):
                    value.write.mode(mode).parquet(f"{path}/{side}/{i}")
                    said["pairs"].setdefault(side, {})[key] = i
                else:  # what JSON can hold; it raises at anything else
                    said["uns"][key] = dict(value) if isinstance(value, Mapping) else value
        spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/table")

    @classmethod
    def read_parquet(cls, spark: SparkSession, path: str, order_parts: int | None = None) -> AxisTable:
        """A table that ``write_parquet`` wrote, with every matrix, side table and its order."""
        said = json.loads(spark.read.text(f"{path}/table").first()[0])
        out = cls.__new__(cls)
        out.validate, out._pairs, out._matrices, out._var = said["validate"], None, {}, None
        aside: dict[str, dict[str, str]] = {OBS: {}, VAR: {}}
        for key, columns, layout, names, slots in said["matrices"]:
            new = {c: hidden("m") for c in columns}
            aside[VAR if key[0] == "varm" else OBS].update(new)
            out._matrices[tuple(key)] = Matrix(tuple(new.values()), layout, tuple(names), tuple(slots))

        def axis(name: str, public: list[str], down: list[bool], named: str | None) -> Axis:
            order = {f"order__{i}": hidden("o") for i in range(len(down))}
            df = spark.read.parquet(f"{path}/{name}").withColumnsRenamed({**aside[name], **order, **({"slot": SLOT} if name == VAR else {})})
            return Axis(df, public, list(zip(order.values(), down, strict=True)), named, order_parts if name == OBS else 1)

        out._obs = axis(OBS, said["obs"], said["order"], said["obs_name"])
        if "var" in said:
            out._var = axis(VAR, said["var"], said["var_order"], said["var_name"])
        sides = {side: {key: spark.read.parquet(f"{path}/{side}/{i}") for key, i in said["pairs"].get(side, {}).items()} for side in ("obsp", "varp", "uns")}
        out._obsp, out._varp, out._uns = sides["obsp"], sides["varp"], {**said["uns"], **sides["uns"]}
        return out

    # -- groups --
    def group_by(self, *, obs: Any = None, var: Any = None):
        if obs is not None and var is not None:
            raise IncompatibleAxisError("group_by takes one axis")
        if obs is None and var is None:
            return self
        axis, request = (OBS, obs) if obs is not None else (VAR, var)
        a = self._axis(axis)
        if any(isinstance(e, E.Expr) and (e.kind != "column" or e.name in (E.OBS_NAMES, E.VAR_NAMES)) for e in _listed(request)):
            raise SelectionError("group_by takes metadata columns")
        keys = a.resolve(request)
        if not keys:
            raise SelectionError("group_by needs a column")
        return GroupedAxisTable(self, axis, keys)

    def count(self, by: Any = None, *, wt: Any = None, sort: bool = False, axis: Any = OBS, name: str = "n") -> DataFrame:
        return self._count(by, wt, sort, axis, name)

    tally = count

    def add_count(self, by: Any = None, *, wt: Any = None, sort: bool = False, axis: Any = OBS, name: str = "n") -> AxisTable:
        return self._add_count(by, wt, sort, axis, name)

    def add_tally(self, *, wt: Any = None, sort: bool = False, axis: Any = OBS, name: str = "n") -> AxisTable:
        return self._add_count(None, wt, sort, axis, name)

    # -- extraction --
    def source(self, source: str, key: str | None = None, layer: str | None = None) -> DataFrame:
        """A source as a frame of its own: names, then a column for each of its columns."""
        return self.as_frame(source, key=key, layer=layer)

    def as_frame(self, source: str, *, key: str | None = None, select: Any = None, layer: str | None = None) -> DataFrame:
        if source in (OBS, VAR):
            a = self._axis(source)
            return a.shown().select(*(F.col(f"`{c}`") for c in a.resolve(select))) if select is not None else a.shown()
        if source in ("obsp", "varp"):
            held = (self._obsp if source == "obsp" else self._varp).get(key)
            if held is None:
                raise UnknownSourceError(f"unknown {source} {key!r}")
            return held
        if source == "uns":
            if key not in self._uns:
                raise UnknownSourceError(f"unknown uns {key!r}")
            held = self._uns[key]
            if not isinstance(held, (DataFrame, Mapping)):
                raise UnknownSourceError(f"uns {key!r} is not a table")
            out = joins.as_frame(self._obs.df, held)
            return out.select(*S.resolve(select, out.columns, out.schema)) if select is not None else out
        if source not in ("x", "raw", "obsm", "varm"):
            raise UnknownSourceError(f"unknown source {source!r}")
        m = self._matrix(source, key if source in ("obsm", "varm") else None, layer)
        a = self._axis(VAR if source == "varm" else OBS)
        names = S.resolve(select if select is not None else S.everything(), list(m.names), _float_types(m))
        lead = [F.col(f"`{a.name}`")] if a.name else [F.col(f"`{c}`") for c, _ in a.order if c in a.public]
        return a.df.select(*lead, *(m.column(n).alias(n) for n in names))

    def pull(self, *, obs=None, var=None, x=None, raw=None, obsm=None, varm=None, obsp=None, varp=None, uns=None, layer: str | None = None) -> DataFrame:
        """One column of one source, as a frame of that column."""
        given = [(k, v) for k, v in (("obs", obs), ("var", var), ("x", x), ("raw", raw), ("obsm", obsm), ("varm", varm), ("obsp", obsp), ("varp", varp), ("uns", uns)) if v is not None]
        if len(given) != 1:
            raise SelectionError("pull takes one source")
        source, request = given[0]
        key = None
        if source in ("obsm", "varm", "obsp", "varp", "uns"):
            if not isinstance(request, Mapping) or len(request) != 1:
                raise SelectionError("pull takes one key")
            key, request = next(iter(request.items()))
        if source in ("obsp", "varp"):
            held = self.as_frame(source, key=key)
            a, b, v = held.columns[:3]
            return held.where(F.col(f"`{b}`") == F.lit(request)).select(F.col(f"`{a}`"), F.col(f"`{v}`").alias(str(request)))
        if source in (OBS, VAR):
            a = self._axis(source)
            names = a.resolve(request)
            frame = a.df
            columns = [F.col(f"`{n}`") for n in names]
        elif source == "uns":
            frame = self.as_frame("uns", key=key)
            names = S.resolve(request, frame.columns, frame.schema)
            columns = [F.col(f"`{n}`") for n in names]
        else:
            m = self._matrix(source, key, layer if source == "x" else None)
            names = S.resolve(request, list(m.names), _float_types(m))
            frame = self._axis(VAR if source == "varm" else OBS).df
            columns = [m.column(n).alias(n) for n in names]
        if len(names) != 1:
            raise SelectionError("pull takes one column")
        return frame.select(*columns)

    def to_df(self, *, obs: Any = None, x: Any = None, raw: Any = None, obsm: Mapping | None = None, obsp: Mapping | None = None, layer: str | None = None, ordered: bool = False, max_matrix_values: int | None = None) -> DataFrame:
        """A wide frame: metadata, then features; raw_ and the key before names of raw and obsm."""
        a = self._obs
        out = [(n, F.col(f"`{n}`")) for n in (a.resolve(obs) if obs is not None else [])]
        wide = []
        for source, key, request, lead in [("x", None, x, ""), ("raw", None, raw, "raw_"), *(("obsm", k, r, f"{k}_") for k, r in (obsm or {}).items())]:
            if request is not None:
                m = self._matrix(source, key, layer if source == "x" else None)
                names = S.resolve(request, list(m.names), _float_types(m))
                wide.append(len(names))
                out += [(lead + n, m.column(n)) for n in names]
        check_budget(a.df, wide, max_matrix_values)
        df = a.df
        for key, request in (obsp or {}).items():
            held = self.as_frame("obsp", key=key)
            r, c, v = held.columns[:3]
            if a.name is None:
                raise SelectionError("pairwise columns need obs names")
            for n in _listed(request):
                at = hidden("pair")
                df = df.join(held.where(F.col(f"`{c}`") == F.lit(n)).select(F.col(f"`{r}`").alias(at), F.col(f"`{v}`").alias(f"{at}_v")), F.col(f"`{a.name}`") == F.col(at), "left")
                out.append((f"{key}_{n}", F.coalesce(F.col(f"{at}_v"), F.lit(0.0))))
        if not out:
            if a.name is None:
                raise SelectionError("nothing is selected and the axis has no names")
            out = [(a.name, F.col(f"`{a.name}`"))]
        if len({n for n, _ in out}) < len(out):
            raise DuplicateNameError("to_df makes equal names")
        df = df.orderBy(*in_order(a.order)) if ordered and a.order else df
        return df.select(*(c.alias(n) for n, c in out))

    def _long(self, obs, x, raw, obs_name, feature, value, layer, allow_all_features, most, meta_first):
        if (x is not None) and (raw is not None):
            raise SelectionError("a long table takes x or raw")
        source, request = ("raw", raw) if raw is not None else ("x", x)
        if request is None and not allow_all_features:
            raise SelectionError("name features, or allow all of them")
        a, m = self._obs, self._matrix(source, layer=layer if source == "x" else None)
        names = S.resolve(request if request is not None else S.everything(), list(m.names), _float_types(m))
        if not names and not allow_all_features:
            raise SelectionError("no feature is selected")
        meta = a.resolve(obs) if obs is not None else []
        new = [obs_name, feature, value, *meta]
        if len(set(new)) < len(new):
            raise NameRepairError("the long table's names clash")
        if a.name is None and not a.order:
            raise SelectionError("rows have neither names nor an order")
        check_budget(a.df, [len(names)], most)
        ident = F.col(f"`{a.name}`") if a.name else F.col(f"`{a.order[-1][0]}`")
        cell = hidden("cell")
        cells = F.explode(F.array(*(F.struct(F.lit(n).alias("f"), m.column(n).alias("v")) for n in names)))
        df = a.df.select(ident.alias(obs_name), *(F.col(f"`{c}`").alias(c) for c in meta), cells.alias(cell))
        long = [F.col(cell)["f"].alias(feature), F.col(cell)["v"].alias(value)]
        extra = [F.col(f"`{c}`") for c in meta]
        return df.select(F.col(f"`{obs_name}`"), *(extra + long if meta_first else long + extra))

    def to_tidy(self, *, obs: Any = None, x: Any = None, raw: Any = None, obs_name: str = "obs_name", feature: str = "feature", value: str = "value", layer: str | None = None, allow_all_features: bool = False, max_matrix_values: int | None = None) -> DataFrame:
        """A row for each observation and feature: name, feature, value, then metadata."""
        return self._long(obs, x, raw, obs_name, feature, value, layer, allow_all_features, max_matrix_values, False)

    def pivot_longer(self, *, obs: Any = None, x: Any = None, raw: Any = None, names_to: str = "name", values_to: str = "value", obs_name: str = "obs_name", layer: str | None = None, allow_all_features: bool = False, max_matrix_values: int | None = None) -> DataFrame:
        """As to_tidy, with metadata before name and value."""
        return self._long(obs, x, raw, obs_name, names_to, values_to, layer, allow_all_features, max_matrix_values, True)

    def nest_by(self, by: Any = None, *, obs: Any = None, var: Any = None, axis: Any = OBS, name: str = "data") -> DataFrame:
        axis = axis_name(axis)
        a = self._axis(axis)
        keys = a.resolve(by)
        request = obs if axis == OBS else var
        columns = a.resolve(request) if request is not None else [c for c in a.public if c not in keys]
        return tidy.nest(a.df, keys, columns, name, [c for c, _ in a.order])

    def feature_means(self, features: Any = None, layer: str | None = None) -> DataFrame:
        """(feature, mean) over all observations of many features: one pass that sums whole rows of the matrix."""
        m = self._matrix("x", layer=layer)
        names = S.resolve(features if features is not None else S.everything(), list(m.names), _float_types(m))
        slots = {n: s for n, s in zip(m.names, m.slots, strict=True)}
        df, spark = self._obs.df, self._obs.df.sparkSession
        want = spark.createDataFrame([(n, slots[n]) for n in names], "feature string, __slot int")
        if m.layout == "sparse_struct":
            cells = df.select(F.explode(F.arrays_zip(F.col(m.columns[0])["indices"].alias("i"), F.col(m.columns[0])["values"].alias("v"))).alias("c")).select(F.col("c")["i"].alias("__slot"), F.col("c")["v"].alias("v"))
            sums = cells.groupBy("__slot").agg(F.sum("v").alias("s")).crossJoin(F.broadcast(df.agg(F.count(F.col(m.columns[0])).alias("n"))))
            return want.join(sums, "__slot", "left").select("feature", F.coalesce(F.try_divide("s", "n"), F.lit(0.0)).alias("mean"))
        if m.layout == "wide":
            sums = df.agg(*(F.avg(m.at(slots[n])).alias(f"c{k}") for k, n in enumerate(names)))
            return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(f"c{k}").alias("mean")) for k, n in enumerate(names)))).alias("r")).select("r.*")
        cells = df.select(F.posexplode(m.columns[0]).alias("__slot", "v"))
        return want.join(cells.groupBy("__slot").agg(F.avg(F.when(~F.isnan("v"), F.col("v"))).alias("mean")), "__slot", "left").select("feature", "mean")


# -- requests ----------------------------------------------------------------------------------------------------------


def _float_types(m: Matrix) -> dict[str, Any]:
    from pyspark.sql.types import DoubleType

    return {n: DoubleType() for n in m.names}


def _predicates(request: Any, names, types) -> list[E.Expr]:
    out = []
    for p in _listed(request):
        if isinstance(p, S.Quantified):
            p = p.expand(names, types)
        out.append(p if isinstance(p, E.Expr) else E.col(p) if isinstance(p, str) else E.lit(p))
    return out


def _assignments(request: Any, names, types) -> dict[str, E.Expr]:
    out: dict[str, E.Expr] = {}
    for item in request if isinstance(request, (list, tuple)) else [request]:
        if isinstance(item, S.Across):
            pairs = item.expand(names, types)
        elif isinstance(item, Mapping):
            pairs = {}
            for n, e in item.items():
                if isinstance(e, S.Across):
                    pairs |= e.expand(names, types)
                else:
                    pairs[n] = e.expand(names, types) if isinstance(e, S.Quantified) else E.column_of(e)
        else:
            raise SelectionError("assignments are a mapping of names to expressions, or across")
        if clash := set(pairs) & set(out):
            raise DuplicateNameError(f"assigned twice: {', '.join(sorted(clash))}")
        out |= pairs
    return out


def _requested(request: Any, names, types) -> list[E.Expr]:
    if isinstance(request, Mapping) or isinstance(request, S.Across) or (isinstance(request, (list, tuple)) and any(isinstance(r, (Mapping, S.Across)) for r in request)):
        return list(_assignments(request, names, types).values())
    return [e for k in _listed(request) for e, _ in _sort_keys(k, names, types)]


def _sort_keys(k: Any, names, types) -> list[tuple[E.Expr, bool]]:
    down = isinstance(k, E.Desc)
    k = k.expr if down else k
    if isinstance(k, S.Selector):
        return [(E.col(n), down) for n in S.resolve(k, names, types)]
    if isinstance(k, S.Quantified):
        return [(k.expand(names, types), down)]
    return [(E.column_of(k), down)]


def _index(names: list, anchor) -> int:
    if anchor not in names:
        raise UnknownColumnError(f"unknown anchor {anchor!r}")
    return names.index(anchor)


def _moved(names: list, chosen: list, before, after) -> list:
    if before is not None and after is not None:
        raise SelectionError("relocate takes before or after")
    anchor = before if before is not None else after
    rest = [n for n in names if n not in chosen]
    if anchor is None:
        return [*chosen, *rest]
    if anchor not in names:
        raise UnknownColumnError(f"unknown anchor {anchor!r}")
    if anchor in chosen:
        raise SelectionError("the anchor is among the columns that move")
    at = rest.index(anchor) + (after is not None)
    return [*rest[:at], *chosen, *rest[at:]]


def _positions(indices: tuple, total: int | None) -> list[int]:
    """Positions asked for; with ``total`` they are checked and negatives resolved, without they are left to each group."""
    out: list[int] = []
    for i in indices:
        if isinstance(i, slice):
            if total is None:
                if i.stop is None or (i.start or 0) < 0 or i.stop < 0:
                    raise SelectionError("slices of groups need plain bounds")
                out += range(i.start or 0, i.stop, i.step or 1)
            else:
                out += range(*i.indices(total))
        elif isinstance(i, (list, tuple, range)):
            values = list(i)
            if values and all(isinstance(v, bool) for v in values):
                if total is not None and len(values) != total:
                    raise SelectionError("a mask must be as long as the axis")
                out += [k for k, v in enumerate(values) if v]
            else:
                out += [int(v) for v in values]
        elif isinstance(i, int) and not isinstance(i, bool):
            out.append(i)
        else:
            raise SelectionError(f"{i!r} is no position")
    if total is not None and any(not -total <= p < total for p in out):
        raise SelectionError("a position is out of range")
    return out


def _width(df: DataFrame, columns: Any, layout: str) -> int:
    """How many places a matrix column has: from its first row (one job), unless it is wide."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    if layout == "wide":
        return len(columns)
    kind = df.schema[columns[0]].dataType
    if isinstance(kind, StructType):
        return int(df.agg(F.max(F.array_max(F.col(f"`{columns[0]}`")["indices"]))).first()[0] or -1) + 1
    if not isinstance(kind, ArrayType):
        raise SizeMismatchError(f"{columns[0]!r} is no array")
    row = df.select(F.size(f"`{columns[0]}`")).first()
    return max(0, row[0]) if row else 0


def _default_names(df: DataFrame, columns: Any, layout: str) -> list[str]:
    return [f"f{k}" for k in range(_width(df, columns, layout))] if layout != "wide" else [columns] if isinstance(columns, str) else list(columns)
