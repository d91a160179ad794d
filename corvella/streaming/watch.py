"""Watchers: Structured Streaming over the change log; each micro-batch reads again what it concerns.

A batch's ids stay a DataFrame, and so does what a watcher remembers: the ids of the result it gave last are the query over the
files of that revision, and equal states are told by a count and a sum of hashes. ``frames=True`` gives DataFrames in place of
rows, so that nothing comes to the driver. Several commits in one batch give one reading.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.errors import ClosedError
from corvella.plans.query import Query
from corvella.sources.store import CHANGES, Database

POLL = "50 milliseconds"


def digest(df: DataFrame) -> tuple:
    """Equal for equal rows, whatever their order."""
    one = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    return tuple(df.agg(F.count(F.lit(1)), F.sum(one)).first())


class Watcher:
    """read: gives (what to emit, its digest or None); equal digests in a row are emitted once."""

    def __init__(self, db: Database, read: Callable[[], tuple[object, object]], emit: Callable[[object], None], concerns: Callable[[DataFrame], bool], first: bool, poll: str):
        if db.closed:
            raise ClosedError("the database is closed")
        self.read, self.emit, self.concerns, self.lock = read, emit, concerns, threading.Lock()
        self.after = db.revision
        now, self.last = read()
        if first:
            emit(now)
        if not db.files.names(f"{db.root}/changes"):
            db.spark.createDataFrame([], CHANGES).write.mode("append").parquet(f"{db.root}/changes")
        log = db.spark.readStream.schema(CHANGES).parquet(f"{db.root}/changes").where(F.col("revision") > self.after)
        self.stream = log.writeStream.foreachBatch(self._batch).trigger(processingTime=poll).start()
        db.streams.append(self)

    def _batch(self, batch: DataFrame, _: int) -> None:
        with self.lock:
            if batch.isEmpty() or not self.concerns(batch):
                return
            now, same = self.read()
            if same is not None and same == self.last:
                return
            self.last = same
            self.emit(now)

    def stop(self) -> None:
        self.stream.stop()

    def settle(self) -> None:
        """Waits for all commits so far; for tests and orderly ends."""
        self.stream.processAllAvailable()


def watch_changes(db: Database, collection: str | None = None) -> DataFrame:
    """The streaming DataFrame of changes (revision, collection, id, op)."""
    log = db.spark.readStream.schema(CHANGES).parquet(f"{db.root}/changes").where("collection is not null")
    return log.where(F.col("collection") == collection) if collection else log


def may_affect(batch: DataFrame, collection: str, id: int) -> bool:
    return not batch.where((F.col("collection") == collection) & (F.col("id") == id)).isEmpty()


def _touches(collection: str) -> Callable[[DataFrame], bool]:
    return lambda b: not b.where(F.col("collection") == collection).isEmpty()


def watch_object(db: Database, collection: str, id: int, emit, fire_immediately: bool = True, poll: str = POLL) -> Watcher:
    """The document or None after a change; equal states in a row are given once."""

    def read():
        row = db.collection(collection).get(id)
        return row, (row,)

    return Watcher(db, read, emit, lambda b: may_affect(b, collection, id), fire_immediately, poll)


def watch_object_lazy(db: Database, collection: str, id: int, emit, poll: str = POLL) -> Watcher:
    return watch_object(db, collection, id, lambda _: emit(None), False, poll)


def watch_collection(db: Database, collection: str, emit, fire_immediately: bool = True, frames: bool = False, poll: str = POLL) -> Watcher:
    """The whole collection after a change, in id order; equal states in a row are given once."""

    def read():
        df = db.collection(collection).all().ordered()
        return df if frames else df.collect(), digest(df)

    return Watcher(db, read, emit, _touches(collection), fire_immediately, poll)


def watch_collection_lazy(db: Database, collection: str, emit, poll: str = POLL) -> Watcher:
    return Watcher(db, lambda: (None, None), emit, _touches(collection), False, poll)


def watch_query(db: Database, query: Query, emit, fire_immediately: bool = True, lazy: bool = False, frames: bool = False, poll: str = POLL) -> Watcher:
    """The query's result again after each change that may concern it: one of the ids seen before, or a changed
    document that matches source and filter now. Equal results are given again."""
    name, key = query.schema.name, query.schema.id
    seen: dict[str, DataFrame] = {}

    def read():
        df = query.ordered()  # bound to the files of this revision
        seen["ids"] = df.select(key)
        return None if lazy else df if frames else df.collect(), None

    def concerns(batch: DataFrame) -> bool:
        mine = batch.where(F.col("collection") == name).select(F.col("id").alias(key)).distinct()
        if mine.isEmpty():
            return False
        if not query.matching().join(mine, key, "left_semi").isEmpty():
            return True
        try:
            return not seen["ids"].join(mine, key, "left_semi").isEmpty()
        except Exception:  # compacted since: those files are gone
            return True

    return Watcher(db, read, emit, concerns, fire_immediately, poll)
