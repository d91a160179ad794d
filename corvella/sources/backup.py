"""Backup archives: JSON lines of a header, schemas, documents and a footer with count and checksum.

Documents are written by Spark as part files; header and footer are lines of their own. The checksum is a sum
of the CRC-32 of the document lines, so it doesn't depend on their order and is computed where the lines are.
Times are microseconds at any depth. Links are not part of an archive.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvella.errors import EngineError
from corvella.schema import CollectionSchema
from corvella.sources.store import Database

FORMAT = 2


def checksum(lines: DataFrame) -> tuple[int, int]:
    """(number of lines, checksum modulo 2**32)."""
    n, h = lines.agg(F.count(F.lit(1)), F.sum(F.crc32(F.col("value").cast("binary")))).first()
    return n, (h or 0) % (1 << 32)


def _timed(kind: T.DataType) -> bool:
    return isinstance(kind, T.TimestampNTZType) or isinstance(kind, T.ArrayType) and _timed(kind.elementType) or isinstance(kind, T.StructType) and any(_timed(f.dataType) for f in kind.fields)


def _raw(kind: T.DataType) -> T.DataType:
    """The type with times as longs."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_raw(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _raw(f.dataType)) for f in kind.fields])
    return T.LongType() if isinstance(kind, T.TimestampNTZType) else kind


def _turned(col, kind: T.DataType, to_micros: bool):
    """Times to microseconds or back, at any depth; nulls stay."""
    if not _timed(kind):
        return col
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _turned(x, kind.elementType, to_micros))
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[_turned(col[f.name], f.dataType, to_micros).alias(f.name) for f in kind.fields]))
    return F.unix_micros(col.cast("timestamp")) if to_micros else F.timestamp_micros(col).cast("timestamp_ntz")


def _lines(db: Database) -> DataFrame | None:
    out = None
    for name in sorted(db.manifest()["collections"]):
        df = db.frame(name)
        row = F.to_json(F.struct(*[_turned(F.col(f.name), f.dataType, True).alias(f.name) for f in df.schema.fields]), {"ignoreNullFields": "false"})
        part = df.select(F.to_json(F.struct(F.lit("doc").alias("type"), F.lit(name).alias("collection"), row.alias("document"))).alias("value"))
        out = part if out is None else out.union(part)
    return out


def export_backup(db: Database, path: str, gzip: bool = False) -> dict:
    """Writes ``path/docs`` and ``path/meta``; returns the footer."""
    with db.read_txn():
        spark, entries = db.spark, db.manifest()["collections"]
        lines = _lines(db)
        lines = spark.createDataFrame([], "value string") if lines is None else lines
        lines.write.option("compression", "gzip" if gzip else "none").text(f"{path}/docs")
        n, h = checksum(spark.read.text(f"{path}/docs"))
        footer = {"type": "footer", "documents": n, "checksum": h}
        meta = [{"type": "header", "format": FORMAT, "revision": db.revision}, *[{"type": "schema", "schema": entries[c]["schema"]} for c in sorted(entries)], footer]
        spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(meta)], "i int, value string").coalesce(1).orderBy("i").select("value").write.text(f"{path}/meta")
        return footer


def import_backup(db: Database, path: str) -> int:
    """Into an empty database; verifies header, count and checksum before anything is written."""
    spark = db.spark
    meta = [json.loads(r.value) for r in spark.read.text(f"{path}/meta").collect()]
    by = {k: [x for x in meta if x["type"] == k] for k in ("header", "schema", "footer")}
    if len(by["header"]) != 1 or by["header"][0].get("format") != FORMAT or len(by["footer"]) != 1:
        raise EngineError("this is no archive of a known format")
    lines = spark.read.text(f"{path}/docs")
    n, h = checksum(lines)
    if (n, h) != (by["footer"][0]["documents"], by["footer"][0]["checksum"]):
        raise EngineError("the archive's count or checksum doesn't match")
    for name in db.manifest()["collections"]:
        if db.frame(name).limit(1).collect():
            raise EngineError("a backup is imported into an empty database")
    doc = F.from_json("value", "type string, collection string, document string")
    rows = lines.select(doc.alias("d")).select("d.*")
    with db.write_txn():
        for x in by["schema"]:
            schema = CollectionSchema.from_json(x["schema"])
            db.register(schema)
            fields = schema.struct().fields
            docs = rows.where(F.col("collection") == schema.name).select(F.from_json("document", _raw(schema.struct())).alias("d")).select("d.*")
            docs = docs.select(*[_turned(F.col(f.name), f.dataType, False).alias(f.name) for f in fields])
            db.put_all(schema.name, docs)
    return n
