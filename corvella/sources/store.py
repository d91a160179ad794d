"""Stored collections: immutable Parquet layers under numbered manifests.

``manifest/rev-N.json`` names, for each collection, a base and the layers of later commits; a commit writes its
layers and then creates the next manifest, which only one writer can do. A layer holds changed rows and
tombstones alone, so a commit costs what it changes, not the size of the collection; a read joins the
layers' last state against the base and costs a plain scan where there is none. ``compact`` merges layers.
Ids come from a counter in the manifest, so they roll back with their transaction. The change log is appended
after the manifest; opening adds what a crash between the two left out. Links are kept the same way: a layer for each
call of ``save_links``. ``compact`` also removes files and manifests that only older revisions need.

A handle may be used by several threads: each has its own transaction, and writers wait for each other.

All files go through the Hadoop file system of the path, so any store that Spark reaches will do.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvella.errors import ClosedError, OpenError, QueryError, SchemaError, TransactionError
from corvella.operators import mutations, relations
from corvella.plans.query import Collection, Query
from corvella.schema import CollectionSchema

CHANGES = "revision long, collection string, id long, op string"
LINKS = "source string, source_id long, link string, target string, targets array<long>"


class Files:
    """The few file operations that a manifest needs."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self.path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.jvm, self.gateway, self.fs = jvm, spark.sparkContext._gateway, self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Fails if the file exists. Readers see the whole file or none: it is written aside and renamed."""
        aside = f"{path}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.path(aside), False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        try:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri())
            rename = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE  # fails if the target is there
            array = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
            array[0] = rename
            context.rename(self.path(aside), self.path(path), array)
        except Exception:
            self.delete(aside)
            raise

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


class Database:
    """One handle over a folder. Reads outside a transaction see the last commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self.closed, self.streams, self.sync, self.temporary = False, [], None, False
        self.own, self.lock = threading.local(), threading.RLock()

    @property
    def txn(self) -> dict | None:
        """The manifest that this thread's read transaction sees."""
        return getattr(self.own, "txn", None)

    @txn.setter
    def txn(self, manifest: dict | None) -> None:
        self.own.txn = manifest

    @property
    def staged(self) -> dict | None:
        """The manifest that this thread's write transaction makes."""
        return getattr(self.own, "staged", None)

    @staged.setter
    def staged(self, manifest: dict | None) -> None:
        self.own.staged = manifest

    @classmethod
    def open(cls, spark: SparkSession, root: str, schemas: list[CollectionSchema] = (), migration=None, sync=None) -> "Database":
        db = cls(spark, root)
        try:
            if db._last() < 0:
                db.files.create(db._name(0), json.dumps({"revision": 0, "migration": 0, "collections": {}, "relations": None, "changed": {}}))
            db._reconcile()
            if migration:
                migration.run(db, schemas)
            for s in schemas:
                db.register(s)
        except (SchemaError, TransactionError):
            raise
        except Exception as e:
            raise OpenError(str(e)) from e
        if sync:
            from corvella.sources.sync import Sync, SyncConfig

            db.sync = Sync(db, sync if isinstance(sync, SyncConfig) else SyncConfig(sync, auto_start=False))
            db.sync.start()
        return db

    @classmethod
    def open_in_memory(cls, spark: SparkSession, schemas: list[CollectionSchema] = ()) -> "Database":
        """A database that goes with ``close``, in the folder that executors share: spark.checkpoint.dir, or the warehouse."""
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
        db = cls.open(spark, f"{shared.rstrip('/')}/corvella-db-{uuid.uuid4().hex}", schemas)
        db.temporary = True
        return db

    # manifests

    def _name(self, revision: int) -> str:
        return f"{self.root}/manifest/rev-{revision:012d}.json"

    def _last(self) -> int:
        found = [int(n[4:16]) for n in self.files.names(f"{self.root}/manifest") if n.startswith("rev-") and n.endswith(".json")]
        return max(found, default=-1)

    def manifest(self) -> dict:
        if self.closed:
            raise ClosedError("the database is closed")
        if self.staged is not None:
            return self.staged
        if self.txn is not None:
            return self.txn
        return json.loads(self.files.read(self._name(self._last())))

    @property
    def revision(self) -> int:
        return self.manifest()["revision"]

    def _entry(self, name: str) -> dict:
        try:
            return self.manifest()["collections"][name]
        except KeyError:
            raise SchemaError(f"no collection {name}") from None

    def schema(self, name: str) -> CollectionSchema:
        return CollectionSchema.from_json(self._entry(name)["schema"])

    def schema_version(self, name: str) -> int:
        return self._entry(name)["version"]

    @property
    def migration_version(self) -> int:
        return self.manifest()["migration"]

    def set_migration_version(self, version: int) -> None:
        with self._writing() as m:
            m["migration"] = version

    # transactions

    @contextmanager
    def read_txn(self):
        """Reads of one revision; writes inside fail."""
        if self.txn is not None or self.staged is not None:
            raise TransactionError("transactions don't nest")
        self.txn = self.manifest()
        try:
            yield self
        finally:
            self.txn = None

    @contextmanager
    def write_txn(self):
        """All or nothing; reads inside see what was written before them."""
        if self.txn is not None or self.staged is not None:
            raise TransactionError("transactions don't nest")
        with self.lock:
            start = self.manifest()
            self.staged = json.loads(json.dumps(start)) | {"revision": start["revision"] + 1, "changed": {}}
            self.own.after, self.own.scratch = [], []
            try:
                yield self
                done = self.staged
            finally:
                self.staged = None
                for path in self.own.scratch:
                    self.files.delete(path)
            if done | {"revision": 0, "changed": {}} == start | {"revision": 0, "changed": {}}:
                return
            try:
                self.files.create(self._name(done["revision"]), json.dumps(done))
            except Exception as e:
                raise TransactionError(f"revision {done['revision']} was committed by another writer") from e
            self._log(done)
            for call in self.own.after:
                call()

    @contextmanager
    def _writing(self):
        if self.closed:
            raise ClosedError("the database is closed")
        if self.txn is not None:
            raise TransactionError("a read transaction can't write")
        if self.staged is not None:
            yield self.staged
        else:
            with self.write_txn():
                yield self.staged

    def _log(self, manifest: dict) -> None:
        """Appends a commit to the change log: the last step, so that nobody hears of what isn't committed."""
        rows = [self.spark.read.parquet(p).select(F.lit(manifest["revision"]).cast("long").alias("revision"), F.lit(c).alias("collection"), F.col("__id").alias("id"), F.col("__op").alias("op")) for c, paths in manifest["changed"].items() for p in paths]
        rows = rows or [self.spark.createDataFrame([(manifest["revision"], None, None, None)], CHANGES)]
        reduce(lambda a, b: a.union(b), rows).write.mode("append").parquet(f"{self.root}/changes")

    def changes(self) -> DataFrame:
        if not self.files.names(f"{self.root}/changes"):
            return self.spark.createDataFrame([], CHANGES)
        return self.spark.read.schema(CHANGES).parquet(f"{self.root}/changes")

    def _reconcile(self) -> None:
        known = self.changes().agg(F.max("revision")).first()[0] or 0
        names = {*self.files.names(f"{self.root}/manifest")}
        for r in range(known + 1, self._last() + 1):
            if self._name(r).rsplit("/", 1)[1] in names:
                self._log(json.loads(self.files.read(self._name(r))))

    # schemas

    def register(self, schema: CollectionSchema, migrated: bool = False, clear: bool = False) -> None:
        """The first time version 1, later one more for each compatible change. ``migrated`` allows any change: stored
        documents are written again, fields cast by name, null where that can't be done; or they go with ``clear``."""
        with self._writing() as m:
            old = m["collections"].get(schema.name)
            if old is None:
                m["collections"][schema.name] = {"schema": schema.to_json(), "version": 1, "next_id": 1, "base": None, "layers": []}
            elif old["schema"] != schema.to_json():
                before = self.schema(schema.name)
                try:
                    schema.compatible_with(before)
                    fits = True
                except SchemaError:
                    if not migrated:
                        raise
                    fits = False
                if clear:
                    old["base"], old["layers"] = None, []
                elif not fits and (old["base"] or old["layers"]):
                    rows = self.frame(schema.name)
                    fields = [F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.struct().fields]
                    path = f"{self.root}/data/{schema.name}/base-{m['revision']:012d}-v{old['version'] + 1}"
                    self.files.delete(path)
                    rows.select(*[F.col(before.id).alias(schema.id) if f.name == schema.id and schema.id not in rows.columns else c for f, c in zip(schema.struct().fields, fields)]).write.parquet(path)
                    old["base"], old["layers"] = path, []
                old["schema"], old["version"] = schema.to_json(), old["version"] + 1

    # reads

    def _stored(self, path: str, schema: CollectionSchema, extra: list[T.StructField] = ()) -> DataFrame:
        return self.spark.read.schema(T.StructType([*schema.struct().fields, *extra])).parquet(path)

    def frame(self, name: str) -> DataFrame:
        e, schema = self._entry(name), self.schema(name)
        base = self._stored(e["base"], schema) if e["base"] else self.spark.createDataFrame([], schema.struct())
        if not e["layers"]:
            return base
        marks = [T.StructField("__id", T.LongType()), T.StructField("__op", T.StringType())]
        layers = [self._stored(p, schema, marks).withColumn("__layer", F.lit(i)) for i, p in enumerate(e["layers"])]
        last = reduce(lambda a, b: a.unionByName(b), layers)
        if len(layers) > 1:
            last = last.withColumn("__nth", F.row_number().over(W.partitionBy("__id").orderBy(F.desc("__layer")))).where("__nth = 1")
        kept = base.join(last.select(F.col("__id").alias(schema.id)), schema.id, "left_anti").select(*base.columns)
        return kept.unionByName(last.where("__op = 'upsert'").select(*base.columns))

    def collection(self, name: str) -> Collection:
        return Collection(self.schema(name), lambda: self.frame(name))

    # writes

    def _layer(self, name: str, rows: DataFrame | None, gone: DataFrame | None, capture: bool = True) -> int:
        """Writes one layer of changed rows and removed ids; returns how many."""
        schema = self.schema(name)
        parts = []
        if rows is not None:
            parts.append(rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.struct().fields]).withColumn("__id", F.col(schema.id)).withColumn("__op", F.lit("upsert")))
        if gone is not None:
            empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.struct().fields]
            parts.append(gone.select(*empty, F.col(schema.id).cast("long").alias("__id"), F.lit("delete").alias("__op")))
        with self._writing() as m:
            e = m["collections"][name]
            path = f"{self.root}/data/{name}/rev-{m['revision']:012d}-{len(e['layers'])}"
            self.files.delete(path)  # of a transaction that was rolled back
            reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).write.parquet(path)
            written = self.spark.read.parquet(path).agg(F.count(F.lit(1)), F.max("__id")).first()
            if written[0]:
                e["layers"].append(path)
                m["changed"].setdefault(name, []).append(path)
                e["next_id"] = max(e["next_id"], written[1] + 1)
                if capture and self.sync:
                    self.sync.capture(name, path, written[0])
            return written[0]

    def allocate_ids(self, name: str, n: int) -> int:
        """The first of n new ids; ids of deleted documents don't come back."""
        with self._writing() as m:
            e = m["collections"][name]
            first, e["next_id"] = e["next_id"], e["next_id"] + n
            return first

    def _staged_rows(self, name: str, rows: DataFrame | list[dict]) -> DataFrame:
        """The batch with its order in ``__n``, evaluated once. Ids that are null or -1 become new ones, in order; those of a
        DataFrame are numbered by partition, so no task gets all rows."""
        schema = self.schema(name)
        kind = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.struct().fields])
        more = T.StructType([*kind.fields, T.StructField("__n", T.LongType())])
        if isinstance(rows, list):
            new = [r.get(schema.id) in (None, -1) for r in rows]
            first = self._free_ids(name, sum(new), [r[schema.id] for r, n in zip(rows, new) if not n])
            ids = iter(range(first, first + len(rows)))
            return self.spark.createDataFrame([(*[next(ids) if f.is_id and n else r.get(f.name) for f in schema.fields], i) for i, (r, n) in enumerate(zip(rows, new))], more)
        path = f"{self.root}/staging/{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in kind.fields], F.monotonically_increasing_id().alias("__n")).write.parquet(path)
        self.own.scratch.append(path)
        batch = self.spark.read.schema(more).parquet(path)
        key, part = F.col(schema.id), F.shiftright("__n", 33)
        new = key.isNull() | (key == -1)
        counts = batch.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("all"), F.sum(new.cast("int")).alias("new"), F.max(F.when(~new, key)).alias("most"), F.min(F.when(~new, key)).alias("least")).orderBy("__part").collect()
        if not sum(c["new"] for c in counts):
            return batch
        first, at, starts = self._free_ids(name, sum(c["all"] for c in counts), [x for c in counts for x in (c["least"], c["most"]) if x is not None]), 0, []
        for c in counts:
            starts.append((c["__part"], first + at))
            at += c["all"]
        # a row for each partition of the batch
        starts = F.broadcast(self.spark.createDataFrame(starts, "__part long, __start long"))
        numbered = batch.withColumn("__part", part).join(starts, "__part")
        return numbered.withColumn(schema.id, F.when(new, F.col("__start") + F.col("__n").bitwiseAND((1 << 33) - 1)).otherwise(key)).select(*batch.columns)

    def _free_ids(self, name: str, n: int, given: list[int]) -> int:
        """The first of n new ids, which don't meet the given ones."""
        if any(x < 0 for x in given):
            raise ValueError(f"id {min(given)} isn't valid")
        first = self._entry(name)["next_id"]
        if n and given and max(given) >= first and min(given) < first + n:
            self.allocate_ids(name, max(given) + 1 - first)
        return self.allocate_ids(name, n) if n else first

    def _write_unique(self, name: str, rows: DataFrame, capture: bool = True) -> int:
        """A layer of rows (with their order in ``__n``) and of the removals that replace indexes ask for."""
        schema = self.schema(name)
        base = self.frame(name)
        kept, gone = mutations.enforce_unique(base, rows, schema)
        return self._layer(name, kept, gone, capture)

    def put_all(self, name: str, rows: DataFrame | list[dict], capture: bool = True) -> int:
        """An atomic upsert of a batch; a repeated or negative id is refused before anything is written. Of rows with the same
        key in a replace index the last one stays, by their order in a list or DataFrame."""
        schema = self.schema(name)
        with self._writing():
            batch = self._staged_rows(name, rows)
            mutations.check_batch(batch, schema.id)
            return self._write_unique(name, batch, capture)

    def put(self, name: str, document: dict) -> int:
        """An upsert of one document; returns its id."""
        schema = self.schema(name)
        with self._writing():
            given = document.get(schema.id, -1)
            id = self.allocate_ids(name, 1) if given in (None, -1) else given
            self.put_all(name, [document | {schema.id: id}])
            return id

    def put_all_by(self, name: str, fields: tuple[str, ...], rows: list[dict] | DataFrame) -> int:
        """An upsert that reuses the id of the document with the same unique key."""
        schema = self.schema(name)
        key = next((k for k in schema.unique_keys() if k[0] == tuple(fields)), None)
        if key is None or not key[1]:
            raise QueryError(f"{name}: {', '.join(fields)} is no unique replace index")
        if isinstance(rows, list):
            rows = self.spark.createDataFrame([tuple(r.get(f.name, -1 if f.is_id else None) for f in schema.fields) for r in rows], T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.struct().fields]))
        with self._writing():
            return self.put_all(name, mutations.reuse_ids(self.frame(name), rows, schema, tuple(fields), key[2]))

    def delete_all(self, name: str, ids: list[int] | DataFrame, capture: bool = True) -> int:
        """Missing ids are ignored."""
        key = self.schema(name).id
        wanted = self.spark.createDataFrame([(int(i),) for i in ids], f"{key} long") if isinstance(ids, list) else ids.select(key)
        with self._writing():
            return self._layer(name, None, self.frame(name).join(wanted, key, "left_semi").select(key), capture)

    def delete(self, name: str, id: int) -> bool:
        return self.delete_all(name, [id]) > 0

    def update_query(self, query: Query, changes: dict) -> int:
        """Sets fields of all matched documents."""
        if self.sync:
            raise QueryError("updates by query aren't captured by sync")
        mutations.checked_changes(query.schema, changes)
        if not changes:
            return 0
        with self._writing():
            name, rows = query.schema.name, mutations.updated_rows(query, changes)
            if not any(f in changes for key in query.schema.unique_keys() for f in key[0]):
                return self._layer(name, rows, None)
            # in the order of their ids, as one after the other would be written
            kept, gone = mutations.enforce_unique(self.frame(name), rows.withColumn("__n", F.col(query.schema.id)), query.schema)
            n = rows.count()
            self._layer(name, kept, gone)
            return n

    def update_first(self, query: Query, changes: dict) -> bool:
        return self.update_query(query.capped(1), changes) > 0

    def delete_query(self, query: Query) -> int:
        with self._writing():
            return self._layer(query.schema.name, None, query.compile().select(query.schema.id))

    def delete_first(self, query: Query) -> bool:
        return self.delete_query(query.capped(1)) > 0

    # relations

    def relations(self) -> DataFrame:
        """All links: the base, and for each source and link that was saved since, its last state."""
        e = self._relations(self.manifest())
        base = self.spark.read.schema(relations.RELATIONS).parquet(e["base"]) if e["base"] else self.spark.createDataFrame([], relations.RELATIONS)
        if not e["layers"]:
            return base
        key = ["source", "source_id", "link"]
        layers = [self.spark.read.schema(LINKS).parquet(p).withColumn("layer", F.lit(i)) for i, p in enumerate(e["layers"])]
        last = reduce(lambda a, b: a.unionByName(b), layers).groupBy(*key).agg(F.max(F.struct("layer", "target", "targets")).alias("x"))
        return base.join(last.select(*key), key, "left_anti").select(*base.columns).unionByName(last.select(*key, "x.target", F.explode("x.targets").alias("target_id")))

    @staticmethod
    def _relations(manifest: dict) -> dict:
        if not isinstance(manifest["relations"], dict):
            manifest["relations"] = {"base": manifest["relations"], "layers": []}
        return manifest["relations"]

    def _link(self, name: str, link: str):
        found = next((x for x in self.schema(name).links if x.name == link), None)
        if not found:
            raise SchemaError(f"{name} has no link {link}")
        return found

    def save_links(self, name: str, link: str, source_id: int, target_ids: list[int], capture: bool = True) -> None:
        x = self._link(name, link)
        if x.backlink_of:
            raise QueryError(f"{name}.{link} is a backlink and can't be saved")
        with self._writing() as m:
            targets = sorted({*target_ids})
            relations.check_ends(name, link, self.frame(name), self.schema(name).id, [source_id], self.frame(x.target), self.schema(x.target).id, targets)
            e = self._relations(m)
            path = f"{self.root}/relations/rev-{m['revision']:012d}-{len(e['layers'])}"
            self.files.delete(path)
            self.spark.createDataFrame([(name, source_id, link, x.target, targets)], LINKS).coalesce(1).write.parquet(path)
            e["layers"].append(path)
            if capture and self.sync:
                self.sync.capture_links(name, link, source_id, x.target, targets)

    def load_links(self, name: str, link: str, source_id: int) -> DataFrame:
        """Targets in id order; of a backlink, the documents that link here."""
        x = self._link(name, link)
        one = lambda c: self.spark.createDataFrame([(source_id,)], f"{c} long")
        if x.backlink_of:
            out = relations.load_backlinks(self.relations(), x.target, x.backlink_of, self.frame(x.target), self.schema(x.target).id, one("target_id")).drop("target_id")
        else:
            out = relations.load_links(self.relations(), name, link, self.frame(x.target), self.schema(x.target).id, one("source_id")).drop("source_id")
        out = out.orderBy(self.schema(x.target).id)
        return out if x.many else out.limit(1)

    # upkeep

    def compact(self, name: str | None = None, files: int | None = None) -> None:
        """Merges the layers of a collection, or of all with the links, into a new base, then removes the files and manifests
        that only older revisions need. Readers of older revisions end with that."""
        with self._writing() as m:
            for n, e in m["collections"].items():
                if name in (None, n) and e["layers"]:
                    path = f"{self.root}/data/{n}/base-{m['revision']:012d}"
                    self.files.delete(path)
                    df = self.frame(n)
                    (df.coalesce(files) if files else df).write.parquet(path)
                    e["base"], e["layers"] = path, []
            links = self._relations(m)
            if name is None and links["layers"]:
                path = f"{self.root}/relations/base-{m['revision']:012d}"
                self.files.delete(path)
                self.relations().write.parquet(path)
                links["base"], links["layers"] = path, []
            m["compacted"] = m["revision"]
            self.own.after.append(self._sweep)

    def _sweep(self) -> None:
        """Removes what the last manifest doesn't name."""
        last = self._last()
        m = json.loads(self.files.read(self._name(last)))
        links = self._relations(m)
        named = {p for e in m["collections"].values() for p in (e["base"], *e["layers"])} | {links["base"], *links["layers"]} | {x["path"] for x in m.get("sync", {}).get("outbox", []) if "path" in x}
        folders = [f"{self.root}/data/{c}" for c in self.files.names(f"{self.root}/data")] + [f"{self.root}/relations"]
        for folder in folders:
            for n in self.files.names(folder):
                if f"{folder}/{n}" not in named:
                    self.files.delete(f"{folder}/{n}")
        for n in self.files.names(f"{self.root}/manifest"):
            if n != self._name(last).rsplit("/", 1)[1]:
                self.files.delete(f"{self.root}/manifest/{n}")

    def close(self) -> None:
        """Waits for a sync cycle that is under way and stops watchers."""
        if self.closed:
            return
        if self.sync:
            self.sync.stop()
        self.staged = self.txn = None
        for s in self.streams:
            s.stop()
        self.closed = True
        if self.temporary:
            self.files.delete(self.root)


def transact(db: Database, function: Callable[[Database], object]):
    """Runs a function in a write transaction and returns its result."""
    with db.write_txn():
        return function(db)
