"""Mutations from DataFrame to DataFrame: upserts, unique keys, updates and deletes. None runs a job but the checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.errors import UniqueIndexError
from corvella.functions.predicates import plain
from corvella.plans.query import Query
from corvella.schema import CollectionSchema


def upsert(base: DataFrame, new: DataFrame, id_field: str) -> DataFrame:
    return base.join(new, id_field, "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


def check_batch(new: DataFrame, id_field: str) -> None:
    twice = new.groupBy(id_field).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"id {twice[0][0]} is twice in one batch")
    bad = new.where(F.col(id_field).isNull() | (F.col(id_field) < 0)).limit(1).collect()
    if bad:
        raise ValueError(f"id {bad[0][id_field]} isn't valid")


def _key(fields: tuple[str, ...], schema: CollectionSchema, case_sensitive: bool) -> list[Column]:
    return [F.lower(F.col(f)) if not case_sensitive and schema.field(f).kind == "string" else F.col(f) for f in fields]


def enforce_unique(base: DataFrame, new: DataFrame, schema: CollectionSchema) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ``new`` that stay, ids of ``base`` that go or None); raises where a unique key is taken.

    ``new`` has the order of its rows in ``__n``. A replace index removes the row that held the key before: of the base, or
    an earlier one of the batch. Keys with a null part are exempt. ``base`` may hold older versions of the new rows;
    those count only if the new version goes too.
    """
    id_field, keys = schema.id, []
    others = base.join(new.select(id_field), id_field, "left_anti")
    kept, clashes = new, []
    for fields, replaces, case_sensitive in sorted(schema.unique_keys(), key=lambda k: not k[1]):
        key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(_key(fields, schema, case_sensitive))])
        keys.append((fields, replaces, key, reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fields])))
    for _, replaces, key, whole in keys:
        if replaces:
            last = new.where(whole).groupBy(key.alias("__key")).agg(F.max("__n").alias("__last"))
            later = new.where(whole).select(id_field, "__n", key.alias("__key")).join(last, "__key").where("__n < __last").select(id_field)
            kept = kept.join(later, id_field, "left_anti")
            clashes.append(others.where(whole).select(F.col(id_field), key.alias("__key")).join(last, "__key").select(id_field))
    gone = None
    if clashes:
        dropped = new.select(id_field).join(kept.select(id_field), id_field, "left_anti").join(base.select(id_field), id_field, "left_semi")
        gone = reduce(lambda a, b: a.union(b), [*clashes, dropped]).distinct()
        others = others.join(gone, id_field, "left_anti")
    for fields, replaces, key, whole in keys:
        if not replaces:
            fresh = kept.where(whole).select(key.alias("__key"))
            if fresh.groupBy("__key").count().where("count > 1").limit(1).collect():
                raise UniqueIndexError(f"{schema.name}: {', '.join(fields)} repeats in one batch")
            if others.where(whole).select(key.alias("__key")).join(fresh, "__key", "left_semi").limit(1).collect():
                raise UniqueIndexError(f"{schema.name}: {', '.join(fields)} is taken")
    return kept.drop("__n"), gone


def reuse_ids(base: DataFrame, new: DataFrame, schema: CollectionSchema, fields: tuple[str, ...], case_sensitive: bool = True) -> DataFrame:
    """``new`` with the ids of the rows in ``base`` that have the same key; a null key part keeps the row's own id."""
    i = schema.id
    key = F.struct(*[k.alias(f"k{n}") for n, k in enumerate(_key(fields, schema, case_sensitive))])
    whole = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fields])
    old = base.where(whole).select(F.col(i).alias("__old"), key.alias("__key"))
    rows = new.withColumn("__key", F.when(whole, key)).join(old, "__key", "left")
    return rows.withColumn(i, F.coalesce("__old", i)).select(*new.columns)


def checked_changes(schema: CollectionSchema, changes: dict) -> dict:
    for name, value in changes.items():
        if schema.field(name).is_id:
            raise ValueError("an id can't be changed")
        if not isinstance(value, (type(None), bool, int, float, str, list, tuple, dict)) and not hasattr(value, "isoformat") and not hasattr(value, "total_seconds"):
            raise ValueError(f"{name}: {type(value).__name__} can't be stored")
        plain(value)
    return changes


def literal(value, kind) -> Column:
    """A typed literal; objects and lists go through their JSON form only when they hold any."""
    if isinstance(value, dict):
        return F.struct(*[literal(value.get(f.name), f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(value, (list, tuple)):
        return F.array(*[literal(v, kind.elementType) for v in value]).cast(kind)
    return F.lit(plain(value)).cast(kind)


def updated_rows(query: Query, changes: dict) -> DataFrame:
    """The matched rows with the changes applied."""
    checked_changes(query.schema, changes)
    rows = query.compile()
    return rows.withColumns({n: literal(v, rows.schema[n].dataType) for n, v in changes.items()}) if changes else rows


def update_all(query: Query, changes: dict) -> DataFrame:
    """The whole collection after the update."""
    base = query.frame()
    if not query.skip and query.most is None and not query.distinct:
        # no window: one pass without a join
        checked_changes(query.schema, changes)
        hit = F.coalesce(query.filter.compile(base.schema) if query.filter else F.lit(True), F.lit(False))
        hit = hit & F.coalesce(query.source.test(base.schema), F.lit(False)) if query.source else hit
        return base.withColumns({n: F.when(hit, literal(v, base.schema[n].dataType)).otherwise(F.col(n)) for n, v in changes.items()}) if changes else base
    return upsert(base, updated_rows(query, changes), query.schema.id)


def delete_all(query: Query) -> DataFrame:
    """The whole collection without the query's rows."""
    base = query.frame()
    return base.join(query.compile().select(query.schema.id), query.schema.id, "left_anti")


def delete_ids(base: DataFrame, ids: DataFrame, id_field: str) -> DataFrame:
    return base.join(ids, id_field, "left_anti")
