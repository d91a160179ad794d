"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

State of an index, all of it DataFrames:

* ``postings`` (doc_id, h1, h2): which document holds which line key, once per document row.
* ``refs`` (h1, h2, refs, owner, last): the exact reference counts, with the smallest and largest holder.
* ``filters`` (shard, blob): one cuckoo filter for each shard of the keys that more than one document holds.

``build`` makes it, ``insert`` and ``delete`` give a new index with documents added or taken away: only keys that those
documents hold are counted again, and keys that became or are no longer repeated are put into or taken out of the filters of
their shards; other filters stay as they are. A filter that gets too full is built again from its shard's exact keys, and
all are, with more shards, once the keys outgrow them by ``GROWTH``. ``apply`` removes lines from texts: the filter of a line's shard discards lines that occur once without
touching the exact table; what passes is decided by the exact table, so false positives change nothing.

A key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased; keys under
``min_chars`` code points never count. Lines with a repeated key stay only in the smallest doc_id that
holds it (every such line there stays).

Cases: null or empty text is one empty line; a null doc_id keeps all its lines and counts for no key;
rows that share a doc_id are one document; an empty table gives an empty table; extra columns are kept
only if named in ``keep``.

Scale: keys are counted with map-side partial sums, so a line held by a third of all documents sends one
row a task; probes are dealt by (shard, salt of doc_id), so no shard is hot; filters are read as a stream
by the tasks that need them and never reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvella.llm.common import Scratch, documents
from corvella.llm.cuckoo import CuckooFilter

SPACE = b" \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 400_000
GROWTH = 4
SALTS = 16


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte digest of the line's key; None if the key is too short to count."""
    key = line.strip(SPACE).lower()  # bytes.lower touches A-Z alone
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def postings_of(docs: DataFrame, min_chars: int = 10, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, counts, keys = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if i is None or not t:
                    continue
                own = {k for line in t.split(b"\n") if (k := line_key(line, min_chars))}
                ids.append(i)
                counts.append(len(own))
                keys.extend(own)
            h = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, dtype=np.int64), np.array(counts, dtype=np.int64))), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["doc_id", "h1", "h2"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, h1 long, h2 long")


def count_refs(postings: DataFrame) -> DataFrame:
    return postings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """One filter for each shard; a shard holds about KEYS_PER_SHARD keys by the hash, however skewed the lines are."""

    def one(table: pa.Table) -> pa.Table:
        h1, h2 = (table.column(c).to_numpy() for c in ("h1", "h2"))
        return pa.table({"shard": table.column("shard")[:1], "blob": pa.array([CuckooFilter.build(h1, h2).to_bytes()], pa.binary())})

    return keys.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "h1", "h2").groupBy("shard").applyInArrow(one, "shard int, blob binary")


def probe(postings: DataFrame, filters: DataFrame, shards: int, salts: int = SALTS) -> DataFrame:
    """The postings whose shard's filter may hold their key: a stream in each task, the filter before its probes."""
    salted = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), "blob")
    asked = postings.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "doc_id", "h1", "h2", F.lit(None).cast("binary").alias("blob"))

    def run(batches):
        at, held = None, None
        for batch in batches:
            shard, salt, kind = (batch.column(i).to_numpy() for i in range(3))
            group = shard.astype(np.int64) * salts + salt
            cuts = np.r_[0, np.flatnonzero((np.diff(group) != 0) | (np.diff(kind) != 0)) + 1, len(group)]
            keep = np.zeros(len(group), bool)
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if kind[a] == 0:
                    at, held = group[a], CuckooFilter.from_bytes(batch.column(6)[int(a)].as_py())
                elif group[a] == at:
                    part = batch.slice(a, b - a)
                    keep[a:b] = held.contains(part.column(4).to_numpy(), part.column(5).to_numpy())
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (3, 4, 5)], names=["doc_id", "h1", "h2"])

    dealt = salted.union(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return dealt.mapInArrow(run, "doc_id long, h1 long, h2 long")


def update_filters(filters: DataFrame, changes: DataFrame, keys: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """``filters`` with changes (h1, h2, added boolean) put in or taken out; untouched shards keep their blobs.

    ``keys``: the exact keys after the changes, for shards whose filter is too full to take its new ones.
    """
    dealt = changes.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "h1", "h2", "added")
    touched = dealt.select("shard").distinct()

    def one(old: pa.Table, new: pa.Table) -> pa.Table:
        h1, h2, added = (new.column(c).to_numpy() for c in ("h1", "h2", "added"))
        f = CuckooFilter.from_bytes(old.column("blob")[0].as_py()) if len(old) else CuckooFilter(2)
        f.delete(h1[~added], h2[~added])
        blob = f.to_bytes() if f.insert(h1[added], h2[added]) else None
        return pa.table({"shard": pa.array([new.column("shard")[0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})

    held = filters.join(touched, "shard", "left_semi")
    changed = scratch.table("changed", held.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(one, "shard int, blob binary"))
    full = changed.where("blob is null").select("shard")
    anew = build_filters(keys.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).join(full, "shard", "left_semi"), shards)
    return filters.join(touched, "shard", "left_anti").union(changed.where("blob is not null")).union(anew)


class LineIndex:
    """An immutable index; ``insert`` and ``delete`` return a new one."""

    def __init__(self, spark: SparkSession, scratch: Scratch, postings: DataFrame, refs: DataFrame, min_chars: int, old: "LineIndex | None" = None, changes: DataFrame | None = None):
        self.spark, self.scratch, self.postings, self.refs, self.min_chars = spark, scratch, postings, refs, min_chars
        self.repeated = scratch.table("repeated", refs.where("owner < last"))
        count = self.repeated.count()
        if old and count <= GROWTH * KEYS_PER_SHARD * old.shards:
            self.shards = old.shards
            self.filters = scratch.table("filters", update_filters(old.filters, changes, self.repeated, self.shards, scratch))
        else:
            self.shards = max(16, count // KEYS_PER_SHARD + 1)
            self.filters = scratch.table("filters", build_filters(self.repeated, self.shards))

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = 10) -> "LineIndex":
        spark = docs.sparkSession
        scratch = Scratch(spark)
        postings = scratch.table("postings", postings_of(docs, min_chars))
        return cls(spark, scratch, postings, count_refs(postings), min_chars)

    def _with(self, scratch: Scratch, postings: DataFrame, counted: DataFrame) -> "LineIndex":
        """counted (h1, h2, refs, owner, last): the new counts of the keys that changed; no refs: the key is gone."""
        key = ["h1", "h2"]
        was = self.refs.join(counted.select(*key), key, "left_semi").select(*key, (F.col("owner") < F.col("last")).alias("was"))
        now = counted.select(*key, F.coalesce(F.col("owner") < F.col("last"), F.lit(False)).alias("added"))
        changes = scratch.table("changes", now.join(was, key, "left").where(F.coalesce("was", F.lit(False)) != F.col("added")).select(*key, "added"))
        refs = self.refs.join(counted.select(*key), key, "left_anti").unionByName(counted.where("refs > 0"))
        return LineIndex(self.spark, scratch, postings, scratch.table("refs", refs), self.min_chars, self, changes)

    def insert(self, docs: DataFrame) -> "LineIndex":
        """With more documents: the counts of their keys are added to those that stand."""
        scratch = Scratch(self.spark)
        new = scratch.table("new", postings_of(docs, self.min_chars))
        more = scratch.table("more", count_refs(new))
        counted = self.refs.join(more.select("h1", "h2"), ["h1", "h2"], "left_semi").union(more).groupBy("h1", "h2").agg(F.sum("refs").alias("refs"), F.min("owner").alias("owner"), F.max("last").alias("last"))
        return self._with(scratch, self.postings.union(new), scratch.table("counted", counted))

    def delete(self, doc_ids: DataFrame) -> "LineIndex":
        """Without some documents: only keys they held are counted again, so a line goes back to the next holder."""
        scratch = Scratch(self.spark)
        ids = doc_ids.select(F.col("doc_id").cast("long")).distinct()
        left = scratch.table("left", self.postings.join(ids, "doc_id", "left_anti"))
        touched = scratch.table("touched", self.postings.join(ids, "doc_id", "left_semi").select("h1", "h2").distinct())
        counted = touched.join(count_refs(left.join(touched, ["h1", "h2"], "left_semi")), ["h1", "h2"], "left").select("h1", "h2", F.coalesce("refs", F.lit(0)).alias("refs"), "owner", "last")
        return self._with(scratch, left, scratch.table("counted", counted))

    def drops(self) -> DataFrame:
        """(doc_id, gone): the keys that each document loses."""
        hits = probe(self.postings, self.filters, self.shards)
        lost = hits.join(self.repeated, ["h1", "h2"]).where("doc_id <> owner")
        return lost.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))

    def apply(self, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """``keep`` columns, then text without dropped lines, n_lines (before), n_dropped."""
        min_chars = self.min_chars
        fields = [f for f in docs.select(*keep).schema.fields]
        out = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        n = len(keep)
        if "text" in keep:
            raise ValueError("the text column is returned rewritten; don't name it in keep")

        def run(batches):
            for batch in batches:
                texts, counts, dropped = [], [], []
                gone = batch.column(n + 1)
                for i, t in enumerate(batch.column(n).cast(pa.binary()).to_pylist()):
                    lines = (t or b"").split(b"\n")
                    counts.append(len(lines))
                    if gone[i].is_valid:
                        pairs = gone[i].values
                        raw = np.stack([pairs.field(0).to_numpy(), pairs.field(1).to_numpy()], 1).astype("<i8").tobytes()
                        lose = {raw[k : k + 16] for k in range(0, len(raw), 16)}
                        lines = [x for x in lines if line_key(x, min_chars) not in lose]
                    dropped.append(counts[-1] - len(lines))
                    texts.append(b"\n".join(lines))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=out.names)

        gone = self.drops().select(F.col("doc_id").alias("__doc"), "gone")
        rows = docs.select(*keep, F.col("text").cast("string").alias("__text"), F.col("doc_id").cast("long").alias("__id"))
        return rows.join(gone, F.col("__id") == F.col("__doc"), "left").select(*keep, "__text", "gone").mapInArrow(run, out)


def dedupe_lines(docs: DataFrame, min_chars: int = 10, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return LineIndex.build(docs, min_chars).apply(docs, keep)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedupe_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, u.pos AS pos, u.line AS line,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_zip(range(1, len(l) + 1), l)) AS z FROM
        (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) t,
       LATERAL (SELECT z[1] AS pos, z[2] AS line) u),
owners AS (
  SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2)
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE o.owner IS NOT NULL AND o.owner <> l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE o.owner IS NULL OR o.owner = l.doc_id), '')) AS kept_sha256
FROM lines l LEFT JOIN owners o ON l.k = o.k GROUP BY l.doc_id
"""
