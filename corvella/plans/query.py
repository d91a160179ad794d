"""The immutable query: source, filter, sort, distinct, offset, limit, whatever the order of the calls.

``compile`` is the only place that knows the execution order, and it runs no job. Order is added only where
it can be observed: by a terminal that lists rows, by distinct, and by offset or limit. The last sort key is always the
id, so results are deterministic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvella.errors import QueryError, SchemaError
from corvella.functions.predicates import All, Any, Filter, _comparable, equals, field, plain
from corvella.functions.text import split_words, tokens
from corvella.operators.aggregates import PropertiesQuery, PropertyQuery
from corvella.schema import CollectionSchema, Index


#: Ids that are pushed into the scan, and that are broadcast (8 MB) to thin out the table; more are shuffled with it.
PUSHED_IDS, BROADCAST_IDS = 1_000, 1_000_000


def _fold(col: Column, case_sensitive: bool) -> Column:
    return col if case_sensitive else F.lower(col)


@dataclass(frozen=True)
class Source:
    """Which rows an index gives: ``test`` makes the predicate; ``order`` the index value, if rows come in its order."""

    test: Callable[[T.StructType], Column]
    order: Callable[[], Column] | None = None


@dataclass(frozen=True)
class Query:
    schema: CollectionSchema
    frame: Callable[[], DataFrame]
    source: Source | None = None
    filter: Filter | None = None
    sorts: tuple[tuple[str, bool], ...] = ()  # (field, descending)
    distinct: tuple[str, ...] = ()
    skip: int = 0
    most: int | None = None
    only_filters: bool = False

    # sources, at most one

    def _from(self, source: Source) -> "Query":
        if self.only_filters:
            raise QueryError("any_of and all_of may only add filters")
        if self.source:
            raise QueryError("a query has one source")
        return replace(self, source=source)

    def _index(self, name: str, *kinds: str) -> Index:
        f = self.schema.field(name)
        if f.is_id:
            return Index()
        if not f.index or f.index.kind not in kinds:
            raise QueryError(f"{self.schema.name}.{name} has no index of kind {' or '.join(kinds)}")
        return f.index

    def equal(self, name: str, value) -> "Query":
        """Rows of an index value; list elements for multiEntry, words for words indexes."""
        index = self._index(name, "value", "hash", "words", "multiEntry")
        if index.kind == "words":
            return self.words_contain(name, value)
        value, kind = plain(value), self.schema.field(name).type()
        folds = not index.case_sensitive and index.kind != "hash"  # a hash index compares exactly
        if index.kind == "multiEntry":
            if folds:
                return self._from(Source(lambda t: F.exists(F.col(name), lambda e: F.lower(e) == F.lower(F.lit(value)))))
            return self._from(Source(lambda t: field(name).contains(value).compile(t)))
        if folds:
            return self._from(Source(lambda t: F.lower(F.col(name)) == F.lower(F.lit(value))))
        return self._from(Source(lambda t: equals(F.col(name), kind, value) if value is not None else F.lit(False)))

    def range(self, name: str, lower=None, upper=None) -> "Query":
        """Both ends included, None for an open end; rows come by (index value, id)."""
        index = self._index(name, "value")
        if lower is None and upper is None:
            raise ValueError("a range needs a bound")
        ends = [plain(x) for x in (lower, upper) if x is not None]
        if any(isinstance(x, bool) for x in ends):
            raise ValueError("bools have no range")
        if len({"n" if isinstance(x, (int, float)) else type(x) for x in ends}) > 1:
            raise ValueError("the bounds of a range are of one kind")
        if not all(_comparable(self.schema.field(name).type(), x) for x in ends):
            raise ValueError(f"{self.schema.name}.{name}: the bounds of a range are of the field's kind")
        value = lambda: _fold(F.col(name), index.case_sensitive)

        def test(_):
            parts = [value() >= _fold(F.lit(plain(lower)), index.case_sensitive)] if lower is not None else []
            parts += [value() <= _fold(F.lit(plain(upper)), index.case_sensitive)] if upper is not None else []
            return parts[0] & parts[1] if len(parts) > 1 else parts[0]

        return self._from(Source(test, value))

    def string_starts_with(self, name: str, prefix: str) -> "Query":
        index = self._index(name, "value", "hash")
        if index.kind == "hash":
            raise QueryError("a hash index has no prefixes")
        value = lambda: _fold(F.col(name), index.case_sensitive)
        return self._from(Source(lambda t: value().startswith(prefix if index.case_sensitive else prefix.lower()), value))

    def _word(self, name: str, text: str):
        index = self._index(name, "words")
        words = split_words(text, index.case_sensitive)
        return (words[0] if words else None), lambda: tokens(F.col(name), index.case_sensitive)

    def words_contain(self, name: str, text: str) -> "Query":
        """Rows that hold the first word of ``text``; none if it has no word."""
        word, held = self._word(name, text)
        return self._from(Source(lambda t: F.lit(False) if word is None else self._holds(name, word) & F.array_contains(held(), word)))

    def _holds(self, name: str, word: str) -> Column:
        """A cheap test that texts with the word pass, so that few are split."""
        return _fold(F.col(name), self.schema.field(name).index.case_sensitive).contains(word)

    def words_start_with(self, name: str, text: str) -> "Query":
        word, held = self._word(name, text)
        return self._from(Source(lambda t: F.lit(False) if word is None else self._holds(name, word) & F.exists(held(), lambda w: w.startswith(word))))

    def composite_equal(self, name: str, values: Iterable) -> "Query":
        c, values = self.schema.composite(name), list(values)
        if len(values) != len(c.fields):
            raise ValueError(f"{name} takes {len(c.fields)} values")

        def test(_):
            out = F.lit(True)
            for n, v in zip(c.fields, values):
                folds = isinstance(v, str) and not c.case_sensitive
                one = F.lower(F.col(n)) == v.lower() if folds else equals(F.col(n), self.schema.field(n).type(), plain(v))
                out = out & (one if v is not None else F.lit(False))
            return out

        return self._from(Source(test))

    # filters

    def where_matches(self, filter: Filter) -> "Query":
        return replace(self, filter=All((self.filter, filter)) if self.filter else filter)

    def optional(self, enabled: bool, change: Callable[["Query"], "Query"]) -> "Query":
        return change(self) if enabled else self

    def _branches(self, items, change) -> tuple[Filter, ...]:
        out, bare = [], replace(self, filter=None, source=None, only_filters=True)
        for item in items:
            q = change(bare, item)
            if replace(q, filter=None) != bare:
                raise QueryError("any_of and all_of may only add filters")
            out.append(q.filter or All(()))
        return tuple(out)

    def any_of(self, items: Iterable, change: Callable[["Query", object], "Query"]) -> "Query":
        """One of the items' filters holds; without items, nothing matches."""
        return self.where_matches(Any(self._branches(items, change)))

    def all_of(self, items: Iterable, change: Callable[["Query", object], "Query"]) -> "Query":
        """All items' filters hold; without items, nothing changes."""
        parts = self._branches(items, change)
        return self.where_matches(All(parts)) if parts else self

    # order and window

    def sort_by(self, name: str, descending: bool = False) -> "Query":
        self.schema.field(name)
        return replace(self, sorts=((name, descending),))

    def then_by(self, name: str, descending: bool = False) -> "Query":
        self.schema.field(name)
        return replace(self, sorts=(*self.sorts, (name, descending)))

    def distinct_by(self, name: str) -> "Query":
        return self.distinct_by_fields([name])

    def distinct_by_fields(self, names: Iterable[str]) -> "Query":
        names = tuple(names)
        if not names:
            raise ValueError("distinct needs a field")
        for n in names:
            self.schema.field(n)
        return replace(self, distinct=names)

    def offset(self, n: int) -> "Query":
        if n < 0:
            raise ValueError("an offset isn't negative")
        return replace(self, skip=n)

    def limit(self, n: int) -> "Query":
        if n < 0:
            raise ValueError("a limit isn't negative")
        return replace(self, most=n)

    # compilation

    def order(self) -> list[Column]:
        """Ascending puts nulls first, descending last."""
        keys = [F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_first() for n, down in self.sorts]
        if not keys and self.source and self.source.order:
            keys = [self.source.order().asc_nulls_first()]
        id_first = any(n == self.schema.id for n, _ in self.sorts)
        return keys if id_first else [*keys, F.col(self.schema.id).asc()]

    def matching(self) -> DataFrame:
        """The rows of source and filter; the filter first, as a source may split texts into words."""
        df = self.frame()
        if self.filter:
            df = df.where(self.filter.compile(df.schema))
        return df.where(self.source.test(df.schema)) if self.source else df

    def compile(self) -> DataFrame:
        """The rows of the query; ordered only as far as offset and limit need it."""
        df = self.matching()
        if self.distinct and self.schema.id not in self.distinct:  # ids are unique: nothing to drop
            first = F.row_number().over(W.partitionBy(*self.distinct).orderBy(*self.order()))
            df = df.withColumn("__nth", first).where("__nth = 1").drop("__nth")
        if self.skip or self.most is not None:
            df = df.orderBy(*self.order())
            df = df.offset(self.skip) if self.skip else df
            df = df.limit(self.most) if self.most is not None else df
        return df

    def ordered(self) -> DataFrame:
        return self.compile().orderBy(*self.order())

    def capped(self, n: int) -> "Query":
        return replace(self, most=n if self.most is None else min(n, self.most))

    # terminals

    def find_all(self) -> list[Row]:
        return self.ordered().collect()

    def find_first(self) -> Row | None:
        rows = self.capped(1).ordered().collect()
        return rows[0] if rows else None

    def ids(self) -> DataFrame:
        return self.ordered().select(self.schema.id)

    def count_frame(self) -> DataFrame:
        return self.compile().agg(F.count(F.lit(1)).alias("count"))

    def count(self) -> int:
        return self.count_frame().first()[0]

    def property(self, name: str, decode: Callable[[Column], Column] | str | None = None, value: Callable | None = None) -> PropertyQuery:
        """decode: a function of the column, or "enum" for the names of an enum field's values. value: a Python function that
        ``find_all`` and ``find_first`` apply to each value on the driver."""
        f = self.schema.field(name)
        if decode == "enum":
            if f.kind != "enum":
                raise QueryError(f"{self.schema.name}.{name} is no enum")
            names = F.create_map(*[F.lit(x) for label, stored in f.enum for x in (stored, label)])
            return PropertyQuery(self, name, lambda c: F.element_at(names, c) if f.enum else c, value)
        return PropertyQuery(self, name, decode, value)

    def properties(self, names: Iterable[str]) -> PropertiesQuery:
        names = tuple(names)
        if not names:
            raise ValueError("a projection needs a field")
        for n in names:
            self.schema.field(n)
        return PropertiesQuery(self, names)


class Collection:
    """A schema over a DataFrame: the start of queries and of reads by id."""

    def __init__(self, schema: CollectionSchema, frame: DataFrame | Callable[[], DataFrame]):
        self.schema = schema
        self.frame = frame if callable(frame) and not isinstance(frame, DataFrame) else lambda: frame

    def all(self) -> Query:
        return Query(self.schema, self.frame)

    where = all

    def filter(self, predicate: Filter) -> Query:
        return self.all().where_matches(predicate)

    def document_ids(self) -> DataFrame:
        return self.frame().select(self.schema.id).orderBy(self.schema.id)

    def document_ids_page(self, after: int | None = None, limit: int = 1000) -> DataFrame:
        if limit <= 0:
            raise ValueError("a page has a size")
        ids = self.frame().select(self.schema.id)
        return (ids if after is None else ids.where(F.col(self.schema.id) > after)).orderBy(self.schema.id).limit(limit)

    def get_frame(self, id: int) -> DataFrame:
        return self.frame().where(F.col(self.schema.id) == id).limit(1)

    def get(self, id: int) -> Row | None:
        rows = self.get_frame(id).collect()
        return rows[0] if rows else None

    def get_all_frame(self, ids: list[int], missing: bool = True) -> DataFrame:
        """A row for each asked id, in order, with ``pos``; a missing id has nulls, or no row without ``missing``."""
        df = self.frame()
        asked = df.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "pos int, __id long")
        key = F.col(self.schema.id)
        if len(ids) <= PUSHED_IDS:
            found = df.where(key.isin([*{*map(int, ids)}]))  # reaches the scan as a filter
        else:  # the ids came from the driver, so they are few beside the table, which they thin out before anything is shuffled
            few = asked.select(F.col("__id").alias(self.schema.id)).distinct()
            found = df.join(F.broadcast(few) if len(ids) <= BROADCAST_IDS else few, self.schema.id, "left_semi")
        return asked.join(found, F.col("__id") == key, "left" if missing else "inner").drop("__id").orderBy("pos")

    def get_all(self, ids: list[int]) -> list[Row | None]:
        if not ids:
            return []
        return [None if r[self.schema.id] is None else r for r in self.get_all_frame(ids).drop("pos").collect()]

    def project_ids(self, ids: list[int], name: str) -> DataFrame:
        """One field of the ids that exist, in the order asked."""
        self.schema.field(name)
        return self.get_all_frame(ids, missing=False).select(name)

    def aggregate_ids(self, ids: list[int], name: str, op: str) -> DataFrame:
        asked = self.frame().sparkSession.createDataFrame([(int(x),) for x in ids], f"{self.schema.id} long")
        frame = lambda: asked.join(self.frame(), self.schema.id)
        return PropertyQuery(Query(self.schema, frame), name).aggregate_frame(op)

    def filter_ids(self, ids: list[int], predicate: Filter) -> DataFrame:
        rows = self.get_all_frame(ids, missing=False)
        return rows.where(predicate.compile(rows.schema)).orderBy("pos").select(self.schema.id)

    def group(self, by: str, **aggregates: Column) -> DataFrame:
        """Extension: grouped sums for dashboards; runs as partial and final hash aggregates."""
        if not self.schema.has(by):
            raise SchemaError(f"{self.schema.name} has no field {by}")
        return self.frame().groupBy(by).agg(*[c.alias(n) for n, c in aggregates.items()])
