"""Versioned migrations: steps from one version to the next, each checked before and after."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from corvella.errors import SchemaError
from corvella.schema import CollectionSchema
from corvella.sources.store import Database


@dataclass(frozen=True)
class Step:
    from_version: int
    to_version: int
    migrate: Callable[["Migration"], None]
    schemas: tuple[CollectionSchema, ...] = ()
    verify_before: Callable[["Migration"], None] | None = None
    verify_after: Callable[["Migration"], None] | None = None


@dataclass(frozen=True)
class Migration:
    """What a step works with: whole collections as DataFrames, in and out."""

    db: Database

    def export_documents(self, name: str) -> DataFrame:
        return self.db.collection(name).all().ordered()

    def import_documents(self, name: str, rows: DataFrame, schema: CollectionSchema | None = None) -> int:
        """With a schema, ``rows`` take the place of all documents; else they are put on top of them."""
        if schema:
            self.db.register(schema, migrated=True, clear=True)
        return self.db.put_all(name, rows)


@dataclass(frozen=True)
class Plan:
    target_version: int
    steps: tuple[Step, ...] = ()
    baseline_version: int = 0
    compact_on_success: bool = True

    def run(self, db: Database, schemas=()) -> list[int]:
        """Versions reached. A fresh database just gets the target version; each step is one transaction."""
        at = db.migration_version
        if not at and not db.manifest()["collections"]:
            db.set_migration_version(self.target_version)
            return []
        at, done = at or self.baseline_version, []
        if at > self.target_version:
            raise SchemaError(f"version {at} is newer than {self.target_version}")
        while at < self.target_version:
            step = next((s for s in self.steps if s.from_version == at), None)
            if step is None or not at < step.to_version <= self.target_version:
                raise SchemaError(f"no step leads on from version {at}")
            with db.write_txn():
                m = Migration(db)
                for call in (step.verify_before, step.migrate):
                    if call:
                        call(m)
                for s in step.schemas:
                    db.register(s, migrated=True)
                if step.verify_after:
                    step.verify_after(m)
                db.set_migration_version(step.to_version)
            at = step.to_version
            done.append(at)
        if done and self.compact_on_success:
            db.compact()
        return done
