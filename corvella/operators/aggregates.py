"""Projections and aggregates over the rows of a query, after its window."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvella.errors import QueryError


@dataclass(frozen=True)
class PropertyQuery:
    query: object
    name: str
    decode: Callable[[Column], Column] | None = None
    value: Callable | None = None

    def _pick(self, rows: DataFrame) -> DataFrame:
        c = F.col(f"`{self.name}`")
        return rows.select((self.decode(c) if self.decode else c).alias(self.name))

    def frame(self) -> DataFrame:
        """Values in query order, nulls and repeats included."""
        return self._pick(self.query.ordered())

    def find_all(self) -> list:
        return [self.value(r[0]) if self.value else r[0] for r in self.frame().collect()]

    def find_first(self):
        rows = self._pick(self.query.capped(1).ordered()).collect()
        return (self.value(rows[0][0]) if self.value else rows[0][0]) if rows else None

    def aggregate_frame(self, op: str) -> DataFrame:
        """One row. count: of values that aren't null. sum and average are doubles whatever the field."""
        rows = self.query.compile()
        kind, c = rows.schema[self.name].dataType, F.col(f"`{self.name}`")
        if op in ("min", "max") and isinstance(kind, (T.BooleanType, T.ArrayType, T.StructType)):
            raise QueryError(f"{self.name} has no {op}")
        if op in ("sum", "average") and not isinstance(kind, (T.NumericType, T.TimestampNTZType)):
            raise QueryError(f"{self.name} has no {op}")
        number = F.unix_micros(c.cast("timestamp")).cast("double") if isinstance(kind, T.TimestampNTZType) else c.cast("double")
        made = {"count": lambda: F.count(c), "min": lambda: F.min(c), "max": lambda: F.max(c), "sum": lambda: F.sum(number), "average": lambda: F.avg(number)}
        if op not in made:
            raise QueryError(f"unknown aggregate {op}")
        return rows.agg(made[op]().alias(op))

    def _value(self, op: str):
        return self.aggregate_frame(op).first()[0]

    def count(self) -> int:
        return self._value("count")

    def min(self):
        return self._value("min")

    def max(self):
        return self._value("max")

    def sum(self) -> float | None:
        return self._value("sum")

    def average(self) -> float | None:
        return self._value("average")


@dataclass(frozen=True)
class PropertiesQuery:
    query: object
    names: tuple[str, ...]

    def frame(self) -> DataFrame:
        return self.query.ordered().select(*[f"`{n}`" for n in self.names])

    def find_all(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.frame().collect()]

    def find_first(self) -> dict | None:
        rows = self.query.capped(1).ordered().select(*[f"`{n}`" for n in self.names]).collect()
        return rows[0].asDict(recursive=True) if rows else None
