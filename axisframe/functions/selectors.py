"""Selectors: rules that name columns once a source's schema is known. They are resolved on the driver, without data."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql.types import DataType, StructType

from ..errors import DuplicateNameError, SelectionError, UnknownColumnError
from . import expr as E


class Selector:
    """``find(names, types)`` gives the selected names in order."""

    def __init__(self, find: Callable[[list[str], dict[str, DataType]], list[str]]):
        self.find = find

    def __or__(self, other: Selector) -> Selector:
        return Selector(lambda n, t: list(dict.fromkeys([*self.find(n, t), *other.find(n, t)])))

    def __and__(self, other: Selector) -> Selector:
        def find(n, t):
            theirs = set(other.find(n, t))
            return [x for x in self.find(n, t) if x in theirs]

        return Selector(find)

    def __invert__(self) -> Selector:
        def find(n, t):
            mine = set(self.find(n, t))
            return [x for x in n if x not in mine]

        return Selector(find)


def _search(pattern: str) -> Selector:
    rule = re.compile(pattern)
    return Selector(lambda n, t: [x for x in n if rule.search(x)])


def starts_with(prefix: str) -> Selector:
    return _search("^" + re.escape(prefix))


def ends_with(suffix: str) -> Selector:
    return _search(re.escape(suffix) + "$")


def contains(text: str, regex: bool = False) -> Selector:
    return _search(text if regex else re.escape(text))


def matches(pattern: str) -> Selector:
    return _search(pattern)


def everything() -> Selector:
    return Selector(lambda n, t: list(n))


def all_of(names: Iterable[str]) -> Selector:
    wanted = [names] if isinstance(names, str) else list(names)

    def find(n, t):
        if missing := [x for x in wanted if x not in n]:
            raise UnknownColumnError(f"unknown columns: {', '.join(missing)}")
        return list(wanted)

    return Selector(find)


def any_of(names: Iterable[str]) -> Selector:
    wanted = [names] if isinstance(names, str) else list(names)
    return Selector(lambda n, t: [x for x in wanted if x in n])


def where(predicate: Callable[[DataType], bool]) -> Selector:
    """Columns whose Spark data type satisfies the predicate."""

    def find(n, t):
        out = []
        for x in n:
            try:
                got = predicate(t[x])
            except Exception as e:
                raise SelectionError(f"where's predicate failed for {x!r}: {e}") from e
            if not isinstance(got, bool):
                raise SelectionError("where's predicate must return a bool")
            if got:
                out.append(x)
        return out

    return Selector(find)


def last_col(offset: int = 0) -> Selector:
    def find(n, t):
        if not 0 <= offset < len(n):
            raise UnknownColumnError(f"there is no column {offset} from the end")
        return [n[-1 - offset]]

    return Selector(find)


def num_range(prefix: str, numbers: Iterable[int], width: int = 0) -> Selector:
    return all_of([f"{prefix}{i:0{width}d}" for i in numbers])


def pick(*selection: Any) -> Selector:
    return Selector(lambda n, t: resolve(list(selection), n, t))


def is_numeric(kind: DataType) -> bool:
    from pyspark.sql.types import NumericType

    return isinstance(kind, NumericType)


def resolve(selection: Any, names: Sequence[str], types: dict[str, DataType] | StructType) -> list[str]:
    """Names of a selection: a name, a selector, a column expression, or a list of these; None selects nothing."""
    if isinstance(types, StructType):
        types = {f.name: f.dataType for f in types}
    names = list(names)
    if selection is None:
        return []
    if isinstance(selection, str):
        if selection not in names:
            raise UnknownColumnError(f"unknown column {selection!r}")
        return [selection]
    if isinstance(selection, Selector):
        return selection.find(names, types)
    if isinstance(selection, E.Expr):
        if selection.kind != "column":
            raise SelectionError("a selection takes columns, not computed expressions")
        return resolve(selection.name, names, types)
    if isinstance(selection, Iterable):
        out: list[str] = []
        for x in selection:
            out.extend(y for y in resolve(x, names, types) if y not in out)
        return out
    raise SelectionError(f"{selection!r} selects nothing")


class Across:
    """The same functions of several columns, as assignments."""

    def __init__(self, selection: Any, functions: Any = None, names: str | None = None):
        self.selection, self.names = selection, names
        if functions is None:
            self.functions = [("", lambda e: e)]
        elif callable(functions):
            self.functions = [("", functions)]
        elif isinstance(functions, dict):
            self.functions = list(functions.items())
        else:
            self.functions = [(getattr(f, "__name__", "") if getattr(f, "__name__", "<lambda>") != "<lambda>" else f"fn{k}", f) for k, f in enumerate(functions, 1)]

    def expand(self, names: Sequence[str], types: Any) -> dict[str, E.Expr]:
        out: dict[str, E.Expr] = {}
        template = self.names or ("{col}" if len(self.functions) == 1 else "{col}_{fn}")
        for c in resolve(self.selection, names, types):
            for label, f in self.functions:
                name = template.format(col=c, fn=label or "fn1")
                if name in out:
                    raise DuplicateNameError(f"across makes {name!r} twice")
                out[name] = f(E.col(c))
        return out


def across(selection: Any, functions: Any = None, names: str | None = None) -> Across:
    return Across(selection, functions, names)


class Quantified:
    """A predicate of several columns, joined by OR or AND."""

    def __init__(self, selection: Any, predicate: Callable[[E.Expr], E.Expr], every: bool):
        self.selection, self.predicate, self.every = selection, predicate, every

    def expand(self, names: Sequence[str], types: Any) -> E.Expr:
        out = None
        for c in resolve(self.selection, names, types):
            part = self.predicate(E.col(c))
            out = part if out is None else out & part if self.every else out | part
        return E.lit(self.every) if out is None else out


def if_any(selection: Any, predicate: Callable[[E.Expr], E.Expr]) -> Quantified:
    return Quantified(selection, predicate, False)


def if_all(selection: Any, predicate: Callable[[E.Expr], E.Expr]) -> Quantified:
    return Quantified(selection, predicate, True)
