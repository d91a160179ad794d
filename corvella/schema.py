"""Collection schemas: fields, indexes, validation, compatibility, Spark types. No Spark session is needed."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from corvella.errors import SchemaError

INDEX_KINDS = ("value", "hash", "words", "multiEntry")
SCALARS = {"bool": T.BooleanType(), "int": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "datetime": T.TimestampNTZType(), "duration": T.LongType()}


@dataclass(frozen=True)
class Index:
    kind: str = "value"
    unique: bool = False
    replace: bool = False
    case_sensitive: bool = True


@dataclass(frozen=True)
class Composite:
    name: str
    fields: tuple[str, ...]
    unique: bool = False
    replace: bool = False
    case_sensitive: bool = True


@dataclass(frozen=True)
class Field:
    """kind: a key of SCALARS, 'enum', 'list' (of ``item``) or 'object' (of ``fields``)."""

    name: str
    kind: str
    nullable: bool = True
    is_id: bool = False
    index: Index | None = None
    item: "Field | None" = None
    fields: tuple["Field", ...] = ()
    enum: tuple[tuple[str, object], ...] = ()  # (name, persisted value)
    source_name: str | None = None  # the name in the program, if it differs from the persisted one

    def type(self) -> T.DataType:
        if self.kind == "list":
            if self.item is None or self.item.kind == "list":
                raise SchemaError(f"{self.name}: a list needs an item type that is no list")
            return T.ArrayType(self.item.type(), True)
        if self.kind == "object":
            return T.StructType([f.struct_field() for f in self.fields])
        if self.kind == "enum":
            value = self.enum[0][1] if self.enum else ""
            return T.BooleanType() if isinstance(value, bool) else T.LongType() if isinstance(value, int) else T.DoubleType() if isinstance(value, float) else T.StringType()
        if self.kind not in SCALARS:
            raise SchemaError(f"{self.name}: unknown type {self.kind}")
        return SCALARS[self.kind]

    def struct_field(self) -> T.StructField:
        meta = {"logical_type": self.kind, "is_id": self.is_id}
        if self.index:
            meta["index"] = dict(vars(self.index))
        if self.source_name:
            meta["source_name"] = self.source_name
        return T.StructField(self.name, self.type(), self.nullable and not self.is_id, meta)


@dataclass(frozen=True)
class Link:
    """A named relation; with ``backlink_of`` the read-only inverse of the target's link of that name."""

    name: str
    target: str
    many: bool = True
    backlink_of: str | None = None


@dataclass(frozen=True)
class CollectionSchema:
    name: str
    fields: tuple[Field, ...]
    composites: tuple[Composite, ...] = ()
    links: tuple[Link, ...] = field(default=())

    def __post_init__(self):
        self.validate()

    @property
    def id(self) -> str:
        return next(f.name for f in self.fields if f.is_id)

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise SchemaError(f"{self.name} has no field {name}")

    def has(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    def composite(self, name: str) -> Composite:
        for c in self.composites:
            if c.name == name:
                return c
        raise SchemaError(f"{self.name} has no composite index {name}")

    def struct(self) -> T.StructType:
        return T.StructType([f.struct_field() for f in self.fields])

    def unique_keys(self) -> list[tuple[tuple[str, ...], bool, bool]]:
        """(fields, replace, case_sensitive) of each unique index."""
        own = [((f.name,), f.index.replace, f.index.case_sensitive) for f in self.fields if f.index and f.index.unique]
        return own + [(c.fields, c.replace, c.case_sensitive) for c in self.composites if c.unique]

    def validate(self) -> None:
        names = [f.name for f in self.fields]
        if not self.name or not all(names):
            raise SchemaError("names can't be empty")
        if len(set(names)) != len(names):
            raise SchemaError(f"{self.name}: field names repeat")
        ids = [f for f in self.fields if f.is_id]
        if len(ids) != 1 or ids[0].kind != "int":
            raise SchemaError(f"{self.name}: exactly one int id field is needed")
        for f in self.fields:
            f.type()
            if not (x := f.index):
                continue
            if x.kind not in INDEX_KINDS:
                raise SchemaError(f"{self.name}.{f.name}: unknown index kind {x.kind}")
            if f.kind == "object":
                raise SchemaError(f"{self.name}.{f.name}: objects can't be indexed")
            if x.replace and not x.unique:
                raise SchemaError(f"{self.name}.{f.name}: replace needs a unique index")
            text = f.kind == "string" or f.kind == "list" and x.kind == "multiEntry" and f.item.kind == "string"
            if not x.case_sensitive and not text:
                raise SchemaError(f"{self.name}.{f.name}: only strings fold their case")
            if x.kind == "words" and f.kind != "string":
                raise SchemaError(f"{self.name}.{f.name}: a words index needs a string")
            if (x.kind == "multiEntry") != (f.kind == "list"):
                raise SchemaError(f"{self.name}.{f.name}: multiEntry and lists go together")
        if len({c.name for c in self.composites}) != len(self.composites):
            raise SchemaError(f"{self.name}: composite names repeat")
        for c in self.composites:
            if len(c.fields) < 2 or not c.name:
                raise SchemaError(f"{self.name}: a composite index has a name and at least two fields")
            if c.replace and not c.unique:
                raise SchemaError(f"{self.name}.{c.name}: replace needs a unique index")
            for n in c.fields:
                if self.field(n).kind in ("list", "object"):
                    raise SchemaError(f"{self.name}.{c.name}: {n} can't be part of a composite index")

    def compatible_with(self, old: "CollectionSchema") -> None:
        """Raises SchemaError unless documents written under ``old`` can be read: only new fields may be added."""
        if self.name != old.name or self.id != old.id:
            raise SchemaError(f"{old.name}: the name and the id field can't change")
        for f in old.fields:
            if not self.has(f.name):
                raise SchemaError(f"{old.name}.{f.name} was removed")
            new = self.field(f.name)
            if replace(new, source_name=None) != replace(f, source_name=None):
                raise SchemaError(f"{old.name}.{f.name} changed its type or index")
        if self.composites != old.composites:
            raise SchemaError(f"{old.name}: composite indexes changed")

    def to_json(self) -> str:
        def plain(x):
            return {k: plain(v) for k, v in vars(x).items()} if hasattr(x, "__dataclass_fields__") else [plain(v) for v in x] if isinstance(x, (tuple, list)) else x

        return json.dumps(plain(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "CollectionSchema":
        def as_field(d):
            return None if d is None else Field(d["name"], d["kind"], d["nullable"], d["is_id"], Index(**d["index"]) if d["index"] else None, as_field(d["item"]), tuple(map(as_field, d["fields"])), tuple((a, b) for a, b in d["enum"]), d["source_name"])

        d = json.loads(text)
        return CollectionSchema(d["name"], tuple(map(as_field, d["fields"])), tuple(Composite(**c | {"fields": tuple(c["fields"])}) for c in d["composites"]), tuple(Link(**x) for x in d["links"]))


def schema_of(name: str, frame_type: T.StructType, id_field: str, indexes: dict[str, Index] | None = None, composites: tuple[Composite, ...] = ()) -> CollectionSchema:
    """A schema for a DataFrame that exists, such as a Parquet table."""

    def as_field(f: T.StructField, top: bool) -> Field:
        t = f.dataType
        kind = {"boolean": "bool", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "double", "double": "double", "string": "string", "timestamp_ntz": "datetime", "timestamp": "datetime", "date": "datetime"}.get(t.simpleString())
        item, fields = None, ()
        if isinstance(t, T.ArrayType):
            kind, item = "list", as_field(T.StructField("item", t.elementType), False)
        elif isinstance(t, T.StructType):
            kind, fields = "object", tuple(as_field(x, False) for x in t.fields)
        if kind is None:
            raise SchemaError(f"{name}.{f.name}: {t.simpleString()} isn't supported")
        return Field(f.name, kind, f.nullable, top and f.name == id_field, (indexes or {}).get(f.name) if top else None, item, fields)

    return CollectionSchema(name, tuple(as_field(f, True) for f in frame_type.fields), composites)
