"""From expressions to Spark columns, in the context of a frame, its groups and its order.

Spark takes no window in a filter and none inside an aggregate, and an aggregate of a whole table over an empty window
would bring every row to one task. So the context owns the frame: such parts become columns of it first (``temp``), and
aggregates of the whole table are computed together as one row that is joined to every row by broadcast; that row is the
only thing that is broadcast here unasked. Aggregates of groups are computed together, too, summed up in every task before
anything is shuffled, and joined to the rows by their keys: Spark broadcasts the groups while they are few, and a group
with a third of all rows is never one task's. Only where rows are brought together by the same keys anyway, as they are
for functions that read the order, are such aggregates windows; and where a frame is the result of MOST_JOINS such joins
already, as each reads the frame twice.

Functions that read the order of a whole table, and its ranks, run in ranges of that order (of the values), so that no task
sorts the table. The bounds are those of a sample, taken by one job after one that counts the rows, and constants of the plan.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DateType, DayTimeIntervalType, DecimalType, DoubleType, FloatType, IntegralType, LongType, NumericType, StringType, StructType, TimestampNTZType, TimestampType

from ..errors import SelectionError
from ..functions.expr import Expr

HIDDEN = "__axisframe_"
MOST_JOINS = 2
#: Rows of a range, the number of ranges at most, sampled rows for each range, and characters of a text in a bound.
RANGE_ROWS, MOST_RANGES, RANGE_SAMPLE, BOUND_TEXT = 1 << 17, 512, 60, 1000
#: Bounds that a row is held against one after the other; of more it meets some, by halves.
FEW_RANGES = 8
_numbers = itertools.count()
_ACROSS_ROWS = {"aggregate", "ordered", "ranked", "partition"}


def hidden(tag: str) -> str:
    """A name for a column that is never shown."""
    return f"{HIDDEN}{tag}_{next(_numbers)}"


def crosses_rows(e: Expr) -> bool:
    return any(x.kind in _ACROSS_ROWS for x in e.walk())


def in_order(order: Sequence[tuple[str, bool]]) -> list[Column]:
    """Sort columns: missing last in both directions."""
    return [F.col(f"`{c}`").desc_nulls_last() if down else F.col(f"`{c}`").asc_nulls_last() for c, down in order]


def _falling(c: Column, kind: DataType) -> list[Column] | None:
    """Columns that grow as ``c`` falls; None for a type that has none."""
    if isinstance(kind, BooleanType):
        return [~c]
    if isinstance(kind, IntegralType):
        return [F.bitwise_not(c)]
    if isinstance(kind, (FloatType, DoubleType)):
        return [~F.isnan(c), -c]
    if isinstance(kind, (DecimalType, DayTimeIntervalType)):
        return [-c]
    if isinstance(kind, TimestampType):
        return [-F.unix_micros(c)]
    if isinstance(kind, TimestampNTZType):
        return [F.lit("1970-01-01").cast("timestamp_ntz") - c]
    if isinstance(kind, DateType):
        return [-F.unix_date(c)]
    if isinstance(kind, BinaryType) or kind == StringType():  # its bytes' complements, and an end that is above all of them
        return [F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))]
    return None


def _flat(c: Column, kind: DataType) -> list[tuple[Column, DataType | None]]:
    """A column, or the fields of a struct in the order in which structs are compared; type None: no constants of a plan."""
    if isinstance(kind, StructType):
        return [(c.isNotNull(), BooleanType()), *(x for f in kind for x in _flat(c.getField(f.name), f.dataType))]
    if isinstance(kind, TimestampType):
        return [(F.unix_micros(c), LongType())]
    if isinstance(kind, TimestampNTZType):
        return [(c - F.lit("1970-01-01").cast("timestamp_ntz"), DayTimeIntervalType())]
    return [(c, kind if isinstance(kind, (BooleanType, NumericType, DateType, DayTimeIntervalType, BinaryType)) or kind == StringType() else None)]


def _sorted_as(v):
    """A constant's place among others of its type as Spark sorts them: missing first, NaN last, texts by their bytes."""
    return (v is not None, v != v, 0 if v is None or v != v else v.encode() if isinstance(v, str) else bytes(v) if isinstance(v, bytearray) else v)


class Context:
    """Compiles expressions over ``df``; read ``df`` again when all are compiled."""

    def __init__(self, df: DataFrame, resolve: Callable[[str], Column], keys: Sequence[str] = (), order: Sequence[tuple[str, bool]] = (), parts: int | None = 1, joins: int = 0):
        self.df, self.resolve, self.keys, self.order, self.parts, self.joins = df, resolve, list(keys), list(order), parts, joins
        self._part: str | None = None
        self._whole = parts == 1
        self._joined_before = joins
        self._pending: list[Column] = []
        self._pending_keys: tuple[str, ...] = ()
        #: The keys of the group windows that this frame needs in any case.
        self.sorted_by: set[tuple[str, ...]] = set()
        self._place: str | None = None
        self.made: list[str] = []

    # -- frame --
    def temp(self, c: Column, tag: str = "t") -> Column:
        self.flush()
        name = hidden(tag)
        self.df = self.df.withColumn(name, c)
        self.made.append(name)
        return F.col(name)

    def flush(self) -> None:
        if not self._pending:
            return
        calls, self._pending, keys = self._pending, [], self._pending_keys
        if not keys:
            self.df = self.df.crossJoin(F.broadcast(self.df.agg(*calls)))
            return
        names = {k: hidden("g") for k in keys}
        groups = self.df.groupBy(*(F.col(f"`{k}`").alias(n) for k, n in names.items())).agg(*calls)
        on = [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in names.items()]
        self.df = self.df.join(groups, reduce(lambda a, b: a & b, on)).drop(*names.values())
        self.joins += 1

    def _joined(self, call: Column) -> Column:
        """An aggregate of the group (of the whole table without keys) as a column that the next flush joins."""
        if tuple(self.keys) != self._pending_keys:
            self.flush()
            self._pending_keys = tuple(self.keys)
        name = hidden("w")
        self._pending.append(call.alias(name))
        self.made.append(name)
        return F.col(name)

    def _repeated(self, e: Expr, args: list[Column]) -> Column:
        """A group's aggregate on each of its rows."""
        if self.keys and not e.alone and (tuple(self.keys) in self.sorted_by or self._joined_before >= MOST_JOINS):
            over = Window.partitionBy(*self._groups())
            return e.make(lambda call: call.over(over), self, *args)
        if e.alone != "python":
            return e.make(self._joined, self, *args)
        self.flush()  # in an aggregation of its own
        out = e.make(self._joined, self, *args)
        self.flush()
        return out

    # -- windows --
    def _groups(self) -> list[Column]:
        return [F.col(f"`{k}`") for k in self.keys]

    def _need_order(self) -> list[Column]:
        if not self.order:
            raise SelectionError("this function reads the order of rows: give the table an order_by")
        return in_order(self.order)

    def in_order(self):
        return Window.partitionBy(*self._groups()).orderBy(*self._need_order())

    def running(self):
        return self.in_order().rowsBetween(Window.unboundedPreceding, 0)

    def last_rows(self, k: int):
        return self.in_order().rowsBetween(-(k - 1), 0)

    def by_value(self, c: Column, descending: bool = False, ties: bool = False, part: Column | None = None):
        order = [c.desc() if descending else c.asc(), *(self._need_order() if ties else ())]
        return Window.partitionBy(*self._groups(), c.isNull() if part is None else part).orderBy(*order)

    def value_part(self, c: Column) -> Column | None:
        """Of an ungrouped table, the range of values that a value lies in, for ranks (-1: missing); None if it is one range."""
        if self.keys or self.parts == 1:
            return None
        self.flush()
        at = self._ranges([c], self.df.where(c.isNotNull()))
        return None if at is None else self.temp(F.when(c.isNull(), -1).otherwise(at), "part")

    def before_part(self, c: Column, part: Column, descending: bool, distinct: bool) -> Column:
        """How many rows (or distinct values) lie in the ranges that sort before a row's: a count for each range, found by a job."""
        many = F.count_distinct(c) if distinct else F.count(c)
        rows = sorted(self.df.where(c.isNotNull()).groupBy(part.alias("p")).agg(many.alias("n")).collect(), reverse=descending)
        starts, sums = {}, 0
        for p, n in rows:
            starts[p], sums = sums, sums + n
        if not starts:
            return F.lit(0)
        return F.get(F.array(*(F.lit(starts.get(k, 0)) for k in range(max(starts) + 1))), F.greatest(part, F.lit(0)))

    def same_value(self, c: Column):
        return Window.partitionBy(*self._groups(), c)

    def _growing(self) -> list[list[Column]]:
        """For each order key the columns that grow along it; as many leading keys as have such columns."""
        types = {f.name: f.dataType for f in self.df.schema}
        out: list[list[Column]] = []
        for name, down in self.order:
            c = F.col(f"`{name}`")
            grows = _falling(c, types[name]) if down else [c]
            if grows is None:
                break
            out.append([c.isNull(), *grows])
        return out

    def place(self) -> Column:
        """An orderable column that grows along the table's order (of a group, where there are keys)."""
        self._need_order()
        found = self._growing()
        if len(found) < len(self.order):  # a key in falling order of a type that can't be turned round
            if self._place is None:
                whole = Window.partitionBy(*self._groups()).orderBy(*in_order(self.order))
                self._place = self.temp(F.row_number().over(whole), "place")
            return self._place
        return F.struct(*(c.alias(f"{'mvw'[i]}{k}") for k, key in enumerate(found) for i, c in enumerate(key)))

    def at_place(self, c: Column, n: int) -> Column:
        """``struct(v)`` of the value on the row at place n of its group (from the end if negative), and missing on all other rows."""
        order = self._need_order() if n >= 0 else [F.col(f"`{name}`").asc_nulls_first() if down else F.col(f"`{name}`").desc_nulls_first() for name, down in self.order]
        want = n + 1 if n >= 0 else -n
        if self.keys:
            at = self.temp(F.row_number().over(Window.partitionBy(*self._groups()).orderBy(*order)), "at")
            return self.temp(F.when(at == want, F.struct(c.alias("v"))), "nth")
        # of the whole table: its first rows alone, a top-n that no task sorts the table for
        self.flush()
        value, rank = hidden("v"), hidden("r")
        some = self.df.withColumn(value, F.struct(c.alias("v"))).orderBy(*order).limit(want)
        there = some.withColumn(rank, F.row_number().over(Window.orderBy(*order))).where(F.col(rank) == want).agg(F.first(value).alias(value))
        self.df = self.df.crossJoin(F.broadcast(there))
        self.made.append(value)
        return F.col(value)

    # -- running aggregates of a whole table, in parts --
    def _ranges(self, keys: Sequence[Column], rows: DataFrame) -> Column | None:
        """The range, from 0 and growing with the keys, that each row lies in; None for one range, or types without constants.

        Equal keys lie in one range. One job counts ``rows`` and one samples their keys; the bounds have as many keys as tell
        them apart, and are constants of the plan: a lost task finds the same.
        """
        typed = [x for k, f in zip(keys, self.df.select(*keys).schema, strict=True) for x in _flat(k, f.dataType)]
        typed = list(itertools.takewhile(lambda x: x[1] is not None, typed))
        if not typed:
            return None
        many = rows.count()
        want = min(MOST_RANGES, -(-many // RANGE_ROWS)) if self.parts is None else self.parts
        if not many or want < 2:
            return None
        names = [f"k{i}" for i in range(len(typed))]
        some = rows.sample(min(1.0, 1.2 * RANGE_SAMPLE * want / many), seed=0)
        some = some.select(*((F.substring(k, 1, BOUND_TEXT) if isinstance(kind, StringType) else k).alias(n) for (k, kind), n in zip(typed, names, strict=True)))
        found = sorted((tuple(r) for r in some.collect()), key=lambda r: [_sorted_as(v) for v in r])
        cuts = [k for k, _ in itertools.groupby(found[len(found) * k // want] for k in range(1, want))] if found else []
        if not cuts:
            return None
        tell = next((p for p in range(1, len(typed)) if all(a[:p] != b[:p] for a, b in itertools.pairwise(cuts))), len(typed))
        literal = lambda v: F.lit(bytes(v) if isinstance(v, bytearray) else v)

        def above(bound: Sequence[Column], k: int = 0) -> Column:
            """Whether the keys from the k-th on are above those of a bound."""
            key, there = typed[k][0], bound[k]
            more = F.coalesce(key > there, there.isNull() & key.isNotNull())
            return more if k == tell - 1 else more | (key.eqNullSafe(there) & above(bound, k + 1))

        if len(cuts) <= FEW_RANGES:  # a smaller plan
            at = reduce(lambda n, cut: n + above([literal(v).cast(kind) for v, (_, kind) in zip(cut, typed[:tell], strict=False)]).cast("int"), cuts, F.lit(0))
            return self.temp(at, "part")
        bounds = {hidden("bounds"): F.array(*map(literal, values)).cast(ArrayType(kind)) for values, (_, kind) in zip(zip(*cuts, strict=True), typed[:tell], strict=False)}
        self.df, made, at = self.df.withColumns(bounds), [], F.lit(0)
        for step in (1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)):  # by halves
            last = at + F.lit(step - 1)
            made.append(hidden("half"))
            self.df = self.df.withColumn(made[-1], at + F.when((last < len(cuts)) & above([F.get(F.col(b), last) for b in bounds]), step).otherwise(0))
            at = F.col(made[-1])
        self.df, self.made = self.df.drop(*bounds, *made[:-1]), [*self.made, made[-1]]
        return at

    def part(self) -> str | None:
        """A column that cuts the table into ranges of its order, growing along it; None if it is one range, or can't be cut."""
        if self._part is None and self.order and not self._whole:
            at = self._ranges([c for key in self._growing() for c in key], self.df)
            self._whole = at is None
            self._part = None if at is None else self.made[-1]
        return self._part

    def _in_parts(self, e: Expr, args: list[Column]) -> Column:
        """A running value within each part, with what the parts before it come to: one value for each part, found by a job."""
        call, fold, combine = e.prefix
        part, total = self._part, hidden("total")
        local = self.temp(call(*args).over(Window.partitionBy(part).orderBy(*in_order(self.order)).rowsBetween(Window.unboundedPreceding, 0)))
        totals = self.df.groupBy(part).agg(call(*args).alias(total))
        earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        sums = totals.select(part, fold(F.col(total)).over(earlier).alias(total))
        kind, found = sums.schema[total].dataType, {r[0]: r[1] for r in sums.collect()}
        before = F.get(F.array(*(F.lit(found.get(k)).cast(kind) for k in range(max(found, default=0) + 1))), F.col(part))
        value = combine(local, before)
        return F.when(args[0].isNotNull(), value) if args and call is not F.count else value

    def _beside(self, e: Expr, args: list[Column]) -> Column | None:
        """A function of a row's neighbours within each part, to which the last and first rows of the parts beside it are lent.

        None where a part has fewer rows than the function reads, which one job finds.
        """
        before, after = e.reach
        part = self._part
        sizes = {r[0]: r[1] for r in self.df.groupBy(part).count().collect()}
        found = sorted(sizes)
        if any(sizes[p] < max(before, after) for p in found):
            return None
        after_of, before_of = dict(zip(found[:-1], found[1:], strict=True)), dict(zip(found[1:], found[:-1], strict=True))
        lent, near = hidden("lent"), hidden("near")
        rows = self.df.withColumn(lent, F.lit(False))
        backward = [F.col(f"`{c}`").asc_nulls_first() if down else F.col(f"`{c}`").desc_nulls_first() for c, down in self.order]
        out = rows
        for n, order, to in ((before, backward, after_of), (after, in_order(self.order), before_of)):
            if n and to:
                target = F.get(F.array(*(F.lit(to.get(k)).cast("int") for k in range(max(found) + 1))), F.col(part))
                edge = rows.withColumn(near, F.row_number().over(Window.partitionBy(part).orderBy(*order))).where(F.col(near) <= n).drop(near)
                out = out.unionByName(edge.withColumn(lent, F.lit(True)).withColumn(part, target).where(F.col(part).isNotNull()))
        self.df = out
        value = self._within([part], lambda: e.make(self, *args))
        held = self.temp(value)
        self.df = self.df.where(~F.col(lent)).drop(lent)
        return held

    # -- compiling --
    def _plain(self, e: Expr) -> Column:
        c = self.column(e)
        return self.temp(c) if crosses_rows(e) else c

    def column(self, e: Expr) -> Column:
        """The value of ``e`` on every row."""
        if e.kind == "column":
            return self.resolve(e.name)
        if e.kind == "literal":
            return F.lit(e.value)
        if e.kind == "scalar":
            return e.make(*(self.column(a) for a in e.args))
        if e.kind == "partition":
            return self._within(list(e.keys), lambda: self.column(e.args[0]))
        args = [self._plain(a) for a in e.args]
        if e.kind == "aggregate":
            return self._repeated(e, args)
        if e.kind == "ordered" and e.prefix and not self.keys and self.part():
            self.flush()
            return self._in_parts(e, args)
        if e.kind == "ordered" and e.reach and not self.keys and self.part():
            self.flush()
            value = self._beside(e, args)
            if value is not None:
                return value
        return e.make(self, *args)

    def _within(self, keys: list[str], make):
        held = self.keys, self._place
        self.keys, self._place = keys, None
        try:
            return make()
        finally:
            self.keys, self._place = held

    def summary(self, e: Expr) -> Column:
        """The value of ``e`` for each group, for use in groupBy(keys).agg."""
        if e.kind == "literal":
            return F.lit(e.value)
        if e.kind == "scalar":
            return e.make(*(self.summary(a) for a in e.args))
        if e.kind == "aggregate":
            if e.alone == "python":  # Spark has no such aggregate beside others: one value of those on the group's rows
                return F.first(self.temp(self._repeated(e, [self._plain(a) for a in e.args])))
            return e.make(lambda call: call, self, *(self._plain(a) for a in e.args))
        raise SelectionError("a summary needs one value for each group: aggregate the columns")
