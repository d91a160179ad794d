"""Predicates as an immutable tree that compiles to Column expressions.

Leaves may be null where a value is missing, so that they still reach the scan as pushed filters; a null counts as
false, and ``Not`` makes it so before it negates. A path walks objects and fans out over lists: any value that
matches is enough, and every leaf fans out on its own.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvella.errors import QueryError


class Filter:
    def compile(self, frame_type: T.StructType) -> Column:
        raise NotImplementedError

    def __and__(self, other: "Filter") -> "Filter":
        return All((self, other))

    def __or__(self, other: "Filter") -> "Filter":
        return Any((self, other))

    def __invert__(self) -> "Filter":
        return Not(self)


@dataclass(frozen=True)
class All(Filter):
    """True if all are; without any, true."""

    parts: tuple[Filter, ...]

    def compile(self, frame_type):
        return reduce(lambda a, b: a & b, [p.compile(frame_type) for p in self.parts]) if self.parts else F.lit(True)


@dataclass(frozen=True)
class Any(Filter):
    """True if one is; without any, false."""

    parts: tuple[Filter, ...]

    def compile(self, frame_type):
        # equalities of one field become one IN, which reaches the scan
        same = [p for p in self.parts if isinstance(p, Leaf) and p.op == "equal_to" and len(p.path) == 1 and isinstance(p.value, (int, str)) and not isinstance(p.value, bool)]
        if len(self.parts) > 1 and len(same) == len(self.parts) and len({p.path for p in same}) == 1:
            f = _field(frame_type, same[0].path[0])
            if f is not None and all(_comparable(f.dataType, p.value) for p in same):
                return F.col(f"`{f.name}`").isin([p.value for p in same])
        return reduce(lambda a, b: a | b, [p.compile(frame_type) for p in self.parts]) if self.parts else F.lit(False)


@dataclass(frozen=True)
class Not(Filter):
    part: Filter

    def compile(self, frame_type):
        return ~F.coalesce(self.part.compile(frame_type), F.lit(False))


@dataclass(frozen=True)
class Custom(Filter):
    """A caller's own predicate: a function from a row struct column to a boolean Column, or a plain Python
    function of a row dict with ``python=True`` (runs as a Python UDF, so it is the slow way)."""

    function: Callable
    python: bool = False

    def compile(self, frame_type):
        row = F.struct(*[F.col(f"`{f.name}`") for f in frame_type.fields])
        if not self.python:
            return self.function(row)
        call = self.function
        return F.udf(lambda r: bool(call(r.asDict(recursive=True))), T.BooleanType())(row)


def _field(kind: T.StructType, name: str) -> T.StructField | None:
    return next((f for f in kind.fields if f.name == name), None)


def _comparable(kind: T.DataType, value) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, T.NumericType)
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    if isinstance(value, (dt.datetime, dt.date)):
        return isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType))
    if isinstance(value, dt.timedelta):
        return isinstance(kind, T.LongType)
    return False


def plain(value):
    """A literal's stored form; non-finite doubles are refused."""
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("doubles must be finite")
    if isinstance(value, dt.timedelta):
        return (value.days * 86_400 + value.seconds) * 1_000_000 + value.microseconds
    if isinstance(value, dt.datetime) and value.tzinfo:
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value


def equals(col: Column, kind: T.DataType, value) -> Column:
    """Deep structural equality with a Python value; null equals None alone."""
    if value is None:
        return col.isNull()
    if isinstance(value, dict):
        if not isinstance(kind, T.StructType) or {f.name for f in kind.fields} != set(value):
            return F.lit(False)
        return reduce(lambda a, b: a & b, [F.coalesce(equals(col[f.name], f.dataType, value[f.name]), F.lit(False)) for f in kind.fields], col.isNotNull())
    if isinstance(value, (list, tuple)):
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        # the size is tested inside, since an index beyond the end is an error
        parts = [F.coalesce(equals(F.get(col, i), kind.elementType, v), F.lit(False)) for i, v in enumerate(value)]
        return reduce(lambda a, b: a & b, parts, F.size(col) == len(value))
    if not _comparable(kind, value):
        return F.lit(False)
    return col == F.lit(plain(value))


_COMPARE = {"greater_than": "__gt__", "at_least": "__ge__", "less_than": "__lt__", "at_most": "__le__"}


@dataclass(frozen=True)
class Leaf(Filter):
    path: tuple[str, ...]
    op: str
    value: object = None

    def _test(self, col: Column, kind: T.DataType) -> Column:
        v, text, many = self.value, isinstance(kind, T.StringType), isinstance(kind, T.ArrayType)
        if self.op == "equal_to":
            return equals(col, kind, v)
        if self.op in _COMPARE:
            if isinstance(v, (bool, str)) or not _comparable(kind, v):
                return F.lit(False)
            return getattr(col, _COMPARE[self.op])(F.lit(plain(v)))
        if self.op == "contains":
            if text:
                return col.contains(v) if isinstance(v, str) else F.lit(False)
            if not many:
                return F.lit(False)
            if v is not None and not isinstance(v, (dict, list, tuple)) and _comparable(kind.elementType, v):
                return F.array_contains(col, F.lit(plain(v)).cast(kind.elementType))
            return F.exists(col, lambda e: F.coalesce(equals(e, kind.elementType, v), F.lit(False)))
        if self.op == "starts_with":
            return col.startswith(v) if text else F.lit(False)
        if self.op == "ends_with":
            return col.endswith(v) if text else F.lit(False)
        if self.op == "length":
            low, high = v
            if not many:
                return F.lit(False)
            n = F.size(col)
            return reduce(lambda a, b: a & b, [x for x in (n >= low if low is not None else None, n <= high if high is not None else None) if x is not None], col.isNotNull())
        raise QueryError(f"unknown predicate {self.op}")

    def _walk(self, col: Column, kind: T.DataType, rest: tuple[str, ...]) -> Column:
        if not rest:
            return self._test(col, kind)
        if isinstance(kind, T.ArrayType):
            return F.exists(col, lambda e: F.coalesce(self._walk(e, kind.elementType, rest), F.lit(False)))
        f = _field(kind, rest[0]) if isinstance(kind, T.StructType) else None
        if f is None:
            return F.lit(False)
        return col.isNotNull() & self._walk(col[f.name], f.dataType, rest[1:])

    def compile(self, frame_type):
        f = _field(frame_type, self.path[0])
        return F.lit(False) if f is None else self._walk(F.col(f"`{f.name}`"), f.dataType, self.path[1:])


class Field:
    """``field("a")`` or ``path("a", "b")``: a maker of leaves."""

    def __init__(self, *names: str):
        if not names or not all(names):
            raise ValueError("a path has at least one name")
        self.path = names

    def _leaf(self, op, value=None):
        plain(value)
        return Leaf(self.path, op, tuple(value) if isinstance(value, list) else value)

    def equal_to(self, value):
        return Leaf(self.path, "equal_to", plain(value))

    def is_null(self):
        return self.equal_to(None)

    def greater_than(self, value):
        return self._leaf("greater_than", value)

    def at_least(self, value):
        return self._leaf("at_least", value)

    def less_than(self, value):
        return self._leaf("less_than", value)

    def at_most(self, value):
        return self._leaf("at_most", value)

    def between(self, low=None, high=None):
        if low is None and high is None:
            raise ValueError("between needs a bound")
        return All(tuple(x for x in (self.at_least(low) if low is not None else None, self.at_most(high) if high is not None else None) if x))

    def contains(self, value):
        return self._leaf("contains", value)

    element_equal_to = contains

    def starts_with(self, value: str):
        return self._leaf("starts_with", value)

    def ends_with(self, value: str):
        return self._leaf("ends_with", value)

    def is_empty(self):
        return Leaf(self.path, "length", (None, 0))

    def is_not_empty(self):
        return Leaf(self.path, "length", (1, None))

    def length_equal_to(self, n: int):
        return Leaf(self.path, "length", (n, n))

    def length_less_than(self, n: int, include: bool = False):
        return Leaf(self.path, "length", (None, n if include else n - 1))

    def length_greater_than(self, n: int, include: bool = False):
        return Leaf(self.path, "length", (n if include else n + 1, None))

    def length_between(self, low: int, high: int, include_lower: bool = True, include_upper: bool = True):
        return All((self.length_greater_than(low, include_lower), self.length_less_than(high, include_upper)))


field = path = Field
