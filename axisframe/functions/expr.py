"""Expressions: trees that are compiled to Spark columns once it is known where they stand.

An aggregate means one value for each group where rows are summarized, and that value repeated on every row elsewhere;
row numbers, leads and cumulative functions follow the declared order of the table, within the group. A tree knows
neither; ``plans.compiler`` does.
"""

from __future__ import annotations

import builtins
import math
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..errors import SelectionError, UnknownColumnError


class Expr:
    """A node: ``kind`` is column, literal, scalar, aggregate, ordered or partition."""

    def __init__(self, kind: str, make: Callable | None = None, args: Iterable[Any] = (), name: str | None = None, value: Any = None, label: str | None = None, keys: tuple[str, ...] | None = None):
        self.kind, self.make, self.args, self.name, self.value, self.label, self.keys = kind, make, tuple(args), name, value, label, keys
        #: For a running aggregate: the aggregate, how parts' totals fold, and how a part's value takes in those before it.
        self.prefix: tuple[Callable, Callable, Callable] | None = None
        #: For a function of neighbours in the order: how many rows before and after a row it reads.
        self.reach: tuple[int, int] | None = None
        #: A comparison of columns and plain values: it also holds for the rows before NaN became missing, so a scan may take it.
        self.plain = False
        #: An aggregate that can't be a window: a distinct one, or one of Python ("python").
        self.alone: bool | str = False

    # -- structure --
    def walk(self) -> Iterable[Expr]:
        yield self
        for a in self.args:
            yield from a.walk()

    def names(self) -> set[str]:
        return {e.name for e in self.walk() if e.kind == "column"} | {k for e in self.walk() for k in e.keys or ()}

    def reads_order(self) -> bool:
        return any(e.kind == "ordered" for e in self.walk())

    def alias(self, name: str) -> Expr:
        return Expr("scalar", lambda c: c, (self,), label=name)

    # -- operators --
    def __bool__(self):
        raise TypeError("an expression has no truth value; use &, | and ~")

    __hash__ = object.__hash__

    def __add__(self, o): return _binary(lambda a, b: a + b, self, o)  # noqa: E704
    def __radd__(self, o): return _binary(lambda a, b: a + b, o, self)  # noqa: E704
    def __sub__(self, o): return _binary(lambda a, b: a - b, self, o)  # noqa: E704
    def __rsub__(self, o): return _binary(lambda a, b: a - b, o, self)  # noqa: E704
    def __mul__(self, o): return _binary(lambda a, b: a * b, self, o)  # noqa: E704
    def __rmul__(self, o): return _binary(lambda a, b: a * b, o, self)  # noqa: E704
    def __truediv__(self, o): return _binary(_divide, self, o)  # noqa: E704
    def __rtruediv__(self, o): return _binary(_divide, o, self)  # noqa: E704
    def __floordiv__(self, o): return _binary(_floor_divide, self, o)  # noqa: E704
    def __rfloordiv__(self, o): return _binary(_floor_divide, o, self)  # noqa: E704
    def __mod__(self, o): return _binary(_modulo, self, o)  # noqa: E704
    def __rmod__(self, o): return _binary(_modulo, o, self)  # noqa: E704
    def __pow__(self, o): return _power(self, o)  # noqa: E704
    def __rpow__(self, o): return _power(o, self)  # noqa: E704
    def __neg__(self): return scalar(lambda a: -a, self)  # noqa: E704
    def __pos__(self): return self  # noqa: E704
    def __eq__(self, o): return _compared(lambda a, b: a == b, self, o)  # noqa: E704
    def __ne__(self, o): return _compared(lambda a, b: a != b, self, o)  # noqa: E704
    def __lt__(self, o): return _compared(lambda a, b: a < b, self, o)  # noqa: E704
    def __le__(self, o): return _compared(lambda a, b: a <= b, self, o)  # noqa: E704
    def __gt__(self, o): return _compared(lambda a, b: a > b, self, o)  # noqa: E704
    def __ge__(self, o): return _compared(lambda a, b: a >= b, self, o)  # noqa: E704
    def __and__(self, o): return _both(self, o)  # noqa: E704
    def __rand__(self, o): return _binary(lambda a, b: a & b, o, self)  # noqa: E704
    def __or__(self, o): return _binary(lambda a, b: a | b, self, o)  # noqa: E704
    def __ror__(self, o): return _binary(lambda a, b: a | b, o, self)  # noqa: E704
    def __invert__(self): return scalar(lambda a: ~a, self)  # noqa: E704

    # -- methods --
    def spark(self, func: Callable[..., Column], *others: Any) -> Expr:
        """Any Spark function of this expression's column (and of others')."""
        return scalar(func, self, *map(value_of, others))

    def cast(self, kind: str) -> Expr: return scalar(lambda c: c.cast(kind), self)  # noqa: E704
    def try_cast(self, kind: str) -> Expr: return scalar(lambda c: c.try_cast(kind), self)  # noqa: E704
    def abs(self) -> Expr: return scalar(F.abs, self)  # noqa: E704
    def floor(self) -> Expr: return scalar(F.floor, self)  # noqa: E704
    def ceil(self) -> Expr: return scalar(F.ceil, self)  # noqa: E704
    def sqrt(self) -> Expr: return scalar(F.sqrt, self)  # noqa: E704
    def exp(self) -> Expr: return scalar(F.exp, self)  # noqa: E704
    def log(self, base: float | None = None) -> Expr: return scalar(lambda c: F.log(c) if base is None else F.log(float(base), c), self)  # noqa: E704
    def round(self, decimals: int = 0) -> Expr: return scalar(lambda c: F.bround(c, decimals), self)  # noqa: E704

    def clip(self, lower: Any = None, upper: Any = None) -> Expr:
        def make(c, *bounds):
            bounds = list(bounds)
            out = c if lower is None else F.greatest(c, bounds.pop(0))
            out = out if upper is None else F.least(out, bounds.pop(0))
            return F.when(c.isNotNull(), out)

        return scalar(make, self, *(value_of(x) for x in (lower, upper) if x is not None))

    def fill_null(self, value: Any) -> Expr: return scalar(F.coalesce, self, value_of(value))  # noqa: E704
    def is_null(self) -> Expr: return is_na(self)  # noqa: E704
    def is_in(self, values: Iterable[Any]) -> Expr: return _among(self, values)  # noqa: E704
    def is_between(self, lower: Any, upper: Any, closed: str = "both") -> Expr: return between(self, lower, upper, closed)  # noqa: E704
    def replace_strict(self, mapping: dict) -> Expr:
        """Every value must be a key of the mapping; another one raises when the plan runs."""

        def make(c, *new):
            out = None
            for old, value in zip(mapping, new, strict=True):
                out = F.when(c.eqNullSafe(F.lit(old)), value) if out is None else out.when(c.eqNullSafe(F.lit(old)), value)
            return out.otherwise(F.raise_error(F.concat(F.lit("replace_strict has no entry for "), F.coalesce(c.cast("string"), F.lit("a missing value")))))

        return scalar(make, self, *map(lit, mapping.values()))

    def n_unique(self) -> Expr: return n_distinct(self)  # noqa: E704
    def sum(self) -> Expr: return sum(self)  # noqa: E704
    def mean(self) -> Expr: return mean(self)  # noqa: E704
    def median(self) -> Expr: return median(self)  # noqa: E704
    def std(self, ddof: int = 1) -> Expr:
        if ddof not in (0, 1):
            raise SelectionError("ddof is 0 or 1")
        return sd(self) if ddof else aggregate(lambda o, ctx, c: o(F.stddev_pop(c)), self)

    def min(self) -> Expr: return min(self)  # noqa: E704
    def max(self) -> Expr: return max(self)  # noqa: E704
    def first(self) -> Expr: return first(self)  # noqa: E704
    def last(self) -> Expr: return last(self)  # noqa: E704
    def len(self) -> Expr: return n()  # noqa: E704
    def count(self) -> Expr: return aggregate(lambda o, ctx, c: o(F.count(c)), self)  # noqa: E704
    def all(self) -> Expr: return aggregate(lambda o, ctx, c: F.coalesce(o(F.every(c)), F.lit(True)), self)  # noqa: E704
    def any(self) -> Expr: return aggregate(lambda o, ctx, c: F.coalesce(o(F.some(c)), F.lit(False)), self)  # noqa: E704
    def cum_sum(self) -> Expr: return cum_sum(self)  # noqa: E704
    def cum_min(self) -> Expr: return cum_min(self)  # noqa: E704
    def cum_max(self) -> Expr: return cum_max(self)  # noqa: E704
    def cum_prod(self) -> Expr: return cum_prod(self)  # noqa: E704
    def cum_count(self) -> Expr: return ordered(lambda ctx, c: F.count(c).over(ctx.running()), self, prefix=(F.count, F.sum, _plus))  # noqa: E704
    def shift(self, n: int) -> Expr: return lag(self, n)  # noqa: E704
    def diff(self) -> Expr: return self - lag(self)  # noqa: E704

    def _rolling(self, func, window: int, min_samples: int | None) -> Expr:
        need = window if min_samples is None else min_samples

        def make(ctx, c):
            spec = ctx.last_rows(window)
            return F.when(F.count(c).over(spec) >= need, func(c).over(spec))

        return ordered(make, self, reach=(window - 1, 0))

    def rolling_sum(self, window: int, min_samples: int | None = None) -> Expr: return self._rolling(F.sum, window, min_samples)  # noqa: E704
    def rolling_mean(self, window: int, min_samples: int | None = None) -> Expr: return self._rolling(F.avg, window, min_samples)  # noqa: E704
    def rolling_min(self, window: int, min_samples: int | None = None) -> Expr: return self._rolling(F.min, window, min_samples)  # noqa: E704
    def rolling_max(self, window: int, min_samples: int | None = None) -> Expr: return self._rolling(F.max, window, min_samples)  # noqa: E704
    def rolling_std(self, window: int, min_samples: int | None = None) -> Expr: return self._rolling(F.stddev_samp, window, min_samples)  # noqa: E704

    def ewm_mean(self, alpha: float | None = None, *, com: float | None = None, span: float | None = None, half_life: float | None = None, adjust: bool = True, min_samples: int = 1, ignore_nulls: bool = False) -> Expr:
        """Exponentially weighted mean of the rows so far; missing rows stay missing and, unless ignored, weights decay over them.

        Rows are summed in blocks whose weights stay within a double; a block takes in the one before it. Older ones weigh less
        than 2 ** -400 and change no digit. So a row costs the same however long its group is.
        """
        given = {"alpha": alpha, "com": com, "span": span, "half_life": half_life}
        given = {k: float(v) for k, v in given.items() if v is not None}
        if len(given) != 1:
            raise SelectionError("ewm_mean takes one of alpha, com, span and half_life")
        name, value = next(iter(given.items()))
        a = {"alpha": lambda v: v, "com": lambda v: 1 / (1 + v), "span": lambda v: 2 / (v + 1), "half_life": lambda v: 1 - 0.5 ** (1 / v)}[name](value)
        if not 0 < a <= 1:
            raise SelectionError("ewm_mean's weight of a new row is over 0 and at most 1")
        keep = 1.0 - a
        size = 1 if not keep else builtins.max(1, int(400 / -math.log2(keep)))

        def make(ctx, c):
            seen = ctx.temp(F.count(c).over(ctx.running()))
            at = (seen if ignore_nulls else ctx.temp(F.row_number().over(ctx.in_order()))) - 1
            block, turn = ctx.temp(F.floor(F.greatest(at, F.lit(0)) / size)), ctx.temp(F.greatest(at, F.lit(0)) % size)
            weight = F.when(c.isNull(), 0.0).when((seen > 1) & F.lit(not adjust), a).otherwise(1.0)
            back = F.pow(F.lit(keep), turn.cast("double")) if keep else F.lit(1.0)
            groups = ctx._groups()
            inside = Window.partitionBy(*groups, block).orderBy(*ctx._need_order()).rowsBetween(Window.unboundedPreceding, 0)
            before = Window.partitionBy(*groups).orderBy(block).rangeBetween(-1, -1)
            sums = []
            for part in (F.coalesce(c.cast("double"), F.lit(0.0)) * weight, weight):
                scaled = ctx.temp(part / back)
                here = ctx.temp(F.sum(scaled).over(inside))
                last = ctx.temp(F.sum(scaled).over(Window.partitionBy(*groups, block)))
                earlier = F.coalesce(ctx.temp(F.max(last).over(before)), F.lit(0.0)) * F.lit(keep**size)
                sums.append((here + earlier) * back)
            return F.when(c.isNotNull() & (seen >= min_samples), sums[0] / sums[1])

        return ordered(make, self)

    def rank(self, method: str = "average", descending: bool = False) -> Expr:
        kinds = {"average": average_rank, "min": min_rank, "max": max_rank, "dense": dense_rank, "ordinal": _ordinal}
        if method not in kinds:
            raise SelectionError(f"unknown rank method {method!r}")
        return kinds[method](self, descending=descending)

    def over(self, *keys: str) -> Expr:
        """This expression within groups of the named columns, whatever the table's groups are."""
        return Expr("partition", None, (self,), keys=tuple(keys))

    def map_batches(self, func: Callable, return_type: str = "double", returns_scalar: bool = False) -> Expr:
        """A pandas function of whole batches of rows (Arrow); it must not depend on how rows fall into batches.

        With ``returns_scalar`` it is an aggregate instead: it is given all values of a group and returns one.
        """
        if returns_scalar:
            return aggregate(lambda o, ctx, c: o(F.pandas_udf(func, return_type, F.PandasUDFType.GROUPED_AGG)(c)), self, alone="python")

        def make(c):
            return F.pandas_udf(func, return_type)(c)

        return scalar(make, self)

    @property
    def str(self) -> _Strings:
        return _Strings(self)

    @property
    def dt(self) -> _Dates:
        return _Dates(self)


class _Strings:
    def __init__(self, e: Expr):
        self._e = e

    def _of(self, func) -> Expr: return scalar(func, self._e)  # noqa: E704
    def to_uppercase(self): return self._of(F.upper)  # noqa: E704
    def to_lowercase(self): return self._of(F.lower)  # noqa: E704
    def to_titlecase(self): return self._of(F.initcap)  # noqa: E704
    def len_chars(self): return self._of(F.char_length)  # noqa: E704
    def starts_with(self, p): return self._of(lambda c: F.startswith(c, F.lit(p)))  # noqa: E704
    def ends_with(self, p): return self._of(lambda c: F.endswith(c, F.lit(p)))  # noqa: E704
    def contains(self, p, literal=False): return self._of(lambda c: F.contains(c, F.lit(p)) if literal else c.rlike(p))  # noqa: E704
    def replace_all(self, p, value, literal=False): return self._of(lambda c: F.replace(c, F.lit(p), F.lit(value)) if literal else F.regexp_replace(c, p, value))  # noqa: E704
    def strip_chars(self, chars=None): return self._of(lambda c: F.trim(c) if chars is None else F.btrim(c, F.lit(chars)))  # noqa: E704
    def slice(self, offset, length=None): return self._of(lambda c: F.substr(c, F.lit(offset + 1 if offset >= 0 else offset), *(() if length is None else (F.lit(length),))))  # noqa: E704
    def head(self, k=5): return self.slice(0, k)  # noqa: E704
    def tail(self, k=5): return self._of(lambda c: F.right(c, F.lit(k)))  # noqa: E704
    def split(self, by): return self._of(lambda c: F.split(c, "\\Q" + by + "\\E"))  # noqa: E704
    def zfill(self, width): return self._of(lambda c: F.when(F.char_length(c) >= width, c).otherwise(F.lpad(c, width, "0")))  # noqa: E704


class _Dates:
    def __init__(self, e: Expr):
        self._e = e

    def _of(self, func) -> Expr: return scalar(func, self._e)  # noqa: E704
    def year(self): return self._of(F.year)  # noqa: E704
    def month(self): return self._of(F.month)  # noqa: E704
    def day(self): return self._of(F.dayofmonth)  # noqa: E704
    def hour(self): return self._of(F.hour)  # noqa: E704
    def minute(self): return self._of(F.minute)  # noqa: E704
    def second(self): return self._of(F.second)  # noqa: E704
    def weekday(self): return self._of(lambda c: F.weekday(c) + 1)  # noqa: E704
    def date(self): return self._of(F.to_date)  # noqa: E704
    def truncate(self, unit): return self._of(lambda c: F.date_trunc(unit, c))  # noqa: E704


class Desc:
    """A sort key in falling order."""

    def __init__(self, e: Expr):
        self.expr = e


# -- building ----------------------------------------------------------------------------------------------------------


def column_of(value: Any) -> Expr:
    """A string names a column; other values are literals."""
    return value if isinstance(value, Expr) else col(value) if isinstance(value, str) else lit(value)


def value_of(value: Any) -> Expr:
    """Strings are literals, like other values."""
    return value if isinstance(value, Expr) else lit(value)


def scalar(make: Callable[..., Column], *args: Expr) -> Expr:
    return Expr("scalar", make, args)


def aggregate(make: Callable[..., Column], *args: Expr, alone: bool | str = False) -> Expr:
    """``make(o, ctx, *columns)``: every aggregate call inside is passed through ``o``."""
    out = Expr("aggregate", make, args)
    out.alone = alone
    return out


def ordered(make: Callable[..., Column], *args: Expr, prefix: tuple[Callable, Callable, Callable] | None = None, reach: tuple[int, int] | None = None) -> Expr:
    """``make(ctx, *columns)`` uses windows over the group in the table's order."""
    out = Expr("ordered", make, args)
    out.prefix, out.reach = prefix, reach
    return out


def _plus(a: Column, b: Column) -> Column:
    return a + F.coalesce(b, F.lit(0))


def ranked(make: Callable[..., Column], *args: Expr) -> Expr:
    """``make(ctx, *columns)`` uses windows over the group that need no table order."""
    return Expr("ranked", make, args)


def _binary(make, a, b) -> Expr:
    return scalar(make, value_of(a), value_of(b))


def _compared(make, a: Expr, b: Any) -> Expr:
    out = _binary(make, a, b)
    fixed = out.args[1]
    out.plain = a.kind == "column" and fixed.kind == "literal" and fixed.value is not None and fixed.value == fixed.value
    return out


def _both(a: Any, b: Any) -> Expr:
    out = _binary(lambda x, y: x & y, a, b)
    out.plain = all(x.plain for x in out.args)
    return out


def _divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _floor_divide(a: Column, b: Column) -> Column:
    return F.floor(_divide(a, b))


def _modulo(a: Column, b: Column) -> Column:
    """Takes the sign of the divisor; by zero it is missing."""
    return F.when(b != 0, a - b * F.floor(a.cast("double") / F.when(b != 0, b.cast("double"))))


def _power(a: Any, b: Any) -> Expr:
    whole = isinstance(b, int) and not isinstance(b, bool) and b >= 0
    base, top = value_of(a), value_of(b)
    if whole:  # integers stay integers
        def make(x, y):
            out = x * 0 + 1
            for _ in range(b):
                out = out * x
            return out

        return scalar(make, base, top) if b <= 8 else scalar(F.pow, base, top)
    return scalar(F.pow, base, top)


def _among(e: Any, values: Iterable[Any]) -> Expr:
    values, e = list(values), column_of(e)
    out = scalar(lambda c: c.isin(values) if values else F.lit(False), e)
    out.plain = e.kind == "column" and bool(values) and all(v is not None and v == v for v in values)
    return out


def col(*names: Any) -> Any:
    """One column, or a list of several; iterables of names are flattened."""
    flat: list[str] = []
    for x in names:
        flat.extend([x] if isinstance(x, str) else x)
    if not flat:
        raise UnknownColumnError("col needs a name")
    out = [Expr("column", name=x) for x in flat]
    return out[0] if len(out) == 1 else out


def lit(value: Any) -> Expr:
    return Expr("literal", value=value)


OBS_NAMES, VAR_NAMES = "__axisframe_obs_names__", "__axisframe_var_names__"
obs_names = Expr("column", name=OBS_NAMES).alias("obs_names")
var_names = Expr("column", name=VAR_NAMES).alias("var_names")


def desc(e: Any) -> Desc:
    return Desc(column_of(e))


# -- aggregates --------------------------------------------------------------------------------------------------------


def n() -> Expr:
    return aggregate(lambda o, ctx: o(F.count(F.lit(1))))


def n_distinct(e: Any) -> Expr:
    """Distinct values; missing counts as one."""
    return aggregate(lambda o, ctx, c: o(F.count_distinct(c)) + F.coalesce(o(F.max(c.isNull().cast("long"))), F.lit(0)), column_of(e), alone=True)


def mean(e: Any) -> Expr:
    return aggregate(lambda o, ctx, c: o(F.avg(c)), column_of(e))


def median(e: Any) -> Expr:
    return aggregate(lambda o, ctx, c: o(F.median(c)), column_of(e))


def sd(e: Any) -> Expr:
    return aggregate(lambda o, ctx, c: o(F.stddev_samp(c)), column_of(e))


def sum(e: Any) -> Expr:  # noqa: A001
    return aggregate(lambda o, ctx, c: F.coalesce(o(F.sum(c)), F.lit(0)), column_of(e))


def min(e: Any) -> Expr:  # noqa: A001
    return aggregate(lambda o, ctx, c: o(F.min(c)), column_of(e))


def max(e: Any) -> Expr:  # noqa: A001
    return aggregate(lambda o, ctx, c: o(F.max(c)), column_of(e))


def first(e: Any) -> Expr:
    """The value at the first place, missing or not."""
    return aggregate(lambda o, ctx, c: o(F.min_by(c, ctx.place())), column_of(e))


def last(e: Any) -> Expr:
    return aggregate(lambda o, ctx, c: o(F.max_by(c, ctx.place())), column_of(e))


def nth(e: Any, n: int, default: Any = None) -> Expr:
    """The value at place n from 0, or from the end if negative; default if there is no such place."""

    def make(o, ctx, c):
        held = ctx.at_place(c, n)
        return F.when(o(F.count(held)) > 0, o(F.first(held, ignorenulls=True))["v"]).otherwise(F.lit(default))

    return aggregate(make, column_of(e))


# -- order and ranks ---------------------------------------------------------------------------------------------------


def row_number() -> Expr:
    return ordered(lambda ctx: F.row_number().over(ctx.in_order()), prefix=(lambda: F.count(F.lit(1)), F.sum, lambda a, b: _plus(a, b).cast("int")))


def _shifted(e: Any, n: int, default: Any) -> Expr:
    if n == 0:
        return column_of(e)
    if n > 0:
        return ordered(lambda ctx, c: F.lag(c, n, default).over(ctx.in_order()), column_of(e), reach=(n, 0))
    return ordered(lambda ctx, c: F.lead(c, -n, default).over(ctx.in_order()), column_of(e), reach=(0, -n))


def lead(e: Any, n: int = 1, default: Any = None) -> Expr:
    return _shifted(e, -n, default)


def lag(e: Any, n: int = 1, default: Any = None) -> Expr:
    return _shifted(e, n, default)


def _rank(func, e: Any, descending: bool, distinct: bool = False) -> Expr:
    def make(ctx, c):
        part = ctx.value_part(c)
        value = func(ctx, c, ctx.by_value(c, descending, part=part))
        return F.when(c.isNotNull(), value if part is None else value + ctx.before_part(c, part, descending, distinct))

    return ranked(make, column_of(e))


def _peers(ctx, c) -> Column:
    return F.count(F.lit(1)).over(ctx.same_value(c))


def min_rank(e: Any, descending: bool = False) -> Expr:
    return _rank(lambda ctx, c, s: F.rank().over(s), e, descending)


def max_rank(e: Any, descending: bool = False) -> Expr:
    return _rank(lambda ctx, c, s: F.rank().over(s) + _peers(ctx, c) - 1, e, descending)


def average_rank(e: Any, descending: bool = False) -> Expr:
    return _rank(lambda ctx, c, s: F.rank().over(s) + (_peers(ctx, c) - 1) / 2, e, descending)


def dense_rank(e: Any, descending: bool = False) -> Expr:
    return _rank(lambda ctx, c, s: F.dense_rank().over(s), e, descending, distinct=True)


def percent_rank(e: Any, descending: bool = False) -> Expr:
    total = n()
    return scalar(lambda r, k: F.when(r.isNotNull(), F.coalesce(F.try_divide((r - 1).cast("double"), (k - 1).cast("double")), F.lit(0.0))), min_rank(e, descending), total)


def cume_dist(e: Any, descending: bool = False) -> Expr:
    return scalar(lambda r, k: r / k, max_rank(e, descending), n())


def _ordinal(e: Any, descending: bool = False) -> Expr:
    def make(ctx, c):
        part = ctx.value_part(c)
        value = F.row_number().over(ctx.by_value(c, descending, ties=True, part=part))
        return F.when(c.isNotNull(), value if part is None else value + ctx.before_part(c, part, descending, False))

    return ordered(make, column_of(e))


def ntile(e: Any, buckets: int) -> Expr:
    """floor((ordinal rank - 1) * buckets / rows) + 1."""
    if buckets < 1:
        raise UnknownColumnError("ntile needs at least one bucket")
    return scalar(lambda r, k: (F.floor((r - 1) * F.lit(buckets) / k) + 1).cast("long"), _ordinal(e), n())


def _running(func, combine) -> Callable[[Any], Expr]:
    def make(e: Any) -> Expr:
        return ordered(lambda ctx, c: F.when(c.isNotNull(), func(c).over(ctx.running())), column_of(e), prefix=(func, func, combine))

    return make


cum_sum, cum_min, cum_max = _running(F.sum, _plus), _running(F.min, F.least), _running(F.max, F.greatest)
cum_prod = _running(F.product, lambda a, b: a * F.coalesce(b, F.lit(1.0)))


def cummean(e: Any) -> Expr:
    return cum_sum(e) / row_number()


def _as_int(e: Any) -> Expr:
    return scalar(lambda c: c.cast("int"), column_of(e))


def cumany(e: Any) -> Expr:
    return cum_sum(_as_int(e)) > 0


def cumall(e: Any) -> Expr:
    return cum_sum(_as_int(e)) == row_number()


# -- conditions --------------------------------------------------------------------------------------------------------


def coalesce(*es: Any) -> Expr:
    return scalar(F.coalesce, *map(column_of, es))


def na_if(e: Any, value: Any) -> Expr:
    return scalar(lambda c, v: F.when((c == v).eqNullSafe(F.lit(True)), F.lit(None)).otherwise(c), column_of(e), value_of(value))


def replace_na(e: Any, value: Any) -> Expr:
    return scalar(F.coalesce, column_of(e), value_of(value))


def is_na(e: Any) -> Expr:
    return scalar(lambda c: c.isNull(), column_of(e))


def if_else(condition: Any, true: Any, false: Any) -> Expr:
    """Strings are literals; a missing condition takes the false branch."""
    return scalar(lambda c, t, f: F.when(c, t).otherwise(f), column_of(condition), value_of(true), value_of(false))


def case_when(*cases: tuple[Any, Any], default: Any = None) -> Expr:
    if not cases:
        raise SelectionError("case_when needs a case")

    def make(*parts):
        out = None
        for c, v in zip(parts[:-1:2], parts[1::2], strict=True):
            out = F.when(c, v) if out is None else out.when(c, v)
        return out.otherwise(parts[-1])

    return scalar(make, *(x for c, v in cases for x in (column_of(c), value_of(v))), value_of(default))


def case_match(e: Any, *cases: tuple[Any, Any], default: Any = None) -> Expr:
    e = column_of(e)
    return case_when(*((_among(e, k) if isinstance(k, (list, tuple, set, frozenset)) else e == k, v) for k, v in cases), default=default)


_KEEP = object()


def recode(e: Any, mapping: dict, default: Any = _KEEP) -> Expr:
    e = column_of(e)
    if not mapping:
        return e if default is _KEEP else value_of(default)
    return case_when(*((e == old, new) for old, new in mapping.items()), default=e if default is _KEEP else default)


def between(e: Any, lower: Any, upper: Any, closed: str = "both") -> Expr:
    if closed not in ("both", "left", "right", "none"):
        raise SelectionError(f"closed is both, left, right or none, not {closed!r}")
    e, lo, hi = column_of(e), value_of(lower), value_of(upper)
    return (e >= lo if closed in ("both", "left") else e > lo) & (e <= hi if closed in ("both", "right") else e < hi)


def near(e: Any, other: Any, tolerance: float = 1e-8) -> Expr:
    return scalar(lambda a, b: F.abs(a - b) <= tolerance, column_of(e), column_of(other))
