"""Near-duplicate documents by bottom-k sketches from one hash function.

1. One pass makes each document's set of distinct word shingles (63-bit hashes), its size, a 128-bit digest
   of the whole set and its ``K`` smallest hashes. Documents with equal sets are one class from here on.
2. Inverted lists of retained values: two sets at the similarity share at least ``SHARE`` of their
   sketches but for about one pair in a hundred million, so it is enough to look at the rarest values of
   each sketch (prefix filter): a pair that shares that many shares one of those. A passage in a third of
   all documents is among the most frequent values of a sketch and so starts no comparison.
3. Each list has a host, one of its classes. The classes of all lists of one host are a group, so near copies, which
   share most of their lists, meet once and not list by list. Each class is first verified against the host that most of
   its lists have; components of these links are the labels.
4. Groups that still hold more than one label are compared in cells: blocks of classes outside the group's main
   label against each other and against blocks of the main label, never main against main, so a group of n near copies
   that its host links makes n rows. A cell has the full sets. A union sketch, the parity bitmap of both sets (its distance
   never exceeds their symmetric difference), discards pairs without loss; exact Jaccard on the full sets decides the
   others. A cell returns a spanning forest of its links, so what is written grows with the classes, not the pairs.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. Cases: with fewer words than the
shingle length the whole sequence is the one shingle; null text or no words gives an empty set, which
links with nothing; rows that share a doc_id count as one document by their equal or smallest set; a null
doc_id is left out; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.llm.common import Memo, Scratch, components, documents, groups_of, id_join

#: Retained values that make the inverted lists.
K = 48
#: Share of a sketch that two sets at 0.75 have in common, less six standard deviations.
SHARE = 0.375
#: Classes and shingles that a block of a cell holds at most, on average.
CELL, CELL_ITEMS = 4096, 1 << 21
#: Bits of the parity bitmap for sets of up to BITS / 4 shingles; it doubles with the sets.
BITS = 2048
#: Shingles that are looked up at a time.
SLICE = 1 << 20
_COEF = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, words: Memo, size: int = 5) -> np.ndarray:
    """Sorted distinct 63-bit hashes of all runs of ``size`` words."""
    w = text.lower().split() if text else []
    if not w:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    n = min(size, len(w))
    s = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        s += h[j : len(w) - n + 1 + j] * _COEF[j]
    return np.unique((_mix(s) >> np.uint64(1)).astype(np.int64))


def _memo() -> Memo:
    return Memo(xxhash.xxh64_intdigest)


def sketches(docs: DataFrame, size: int = 5, k: int = K) -> DataFrame:
    def run(batches):
        words = _memo()
        for batch in batches:
            ids, n, digests, ends, parts = [], [], [], [0], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if i is None:
                    continue
                s = shingles(t, words, size)
                ids.append(i)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                parts.append(s[:k])
                ends.append(ends[-1] + len(parts[-1]))
            d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            flat = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["doc_id", "n", "h1", "h2", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sketch array<long>")


def full_sets(docs: DataFrame, size: int = 5) -> DataFrame:
    """(cls, items): the full set, sorted."""

    def run(batches):
        words = _memo()
        for batch in batches:
            parts = [shingles(t, words, size) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            ends = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
            flat = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["cls", "items"])

    return docs.mapInArrow(run, "cls long, items array<long>")


def _parity(items: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """For each set the parities of how many of its hashes fall on each bit."""
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    out = np.zeros((len(ends) - 1) * bits, np.uint8)
    np.bitwise_xor.at(out, row * bits + (items & (bits - 1)), 1)
    return np.packbits(out).view(np.uint64).reshape(len(ends) - 1, -1)


def cell_links(label: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links at the similarity that join different labels, as a forest of (row, row).

    side: 0 or 1; where it holds both, only rows of different sides are compared, else all.
    """
    j = percent / 100
    n = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(n, kind="stable")
    n, side, sets = n[order], side[order], [sets[k] for k in order]
    comp = np.unique(label[order], return_inverse=True)[1]
    crossed = side.min() != side.max()
    level, held, first, out = -1, None, 0, []
    for r in range(1, len(n)):
        low = int(np.searchsorted(n, -(-percent * n[r] // 100)))
        at = np.arange(low, r)[comp[low:r] != comp[r]]
        at = at[side[at] != side[r]] if crossed else at
        if not len(at):
            continue
        if (now := max(0, int(4 * n[r] - 1).bit_length() - BITS.bit_length() + 1)) != level:
            # bitmaps of all sets that those of this level can be compared with
            level, first = now, low
            last = int(np.searchsorted(n, (BITS << level) // 4, side="right"))
            ends = np.r_[0, np.cumsum(n[first:last])]
            held = np.concatenate([_parity(np.concatenate(sets[first:last][k : k + 256]), ends[k : k + 257] - ends[k], BITS << level) for k in range(0, last - first, 256)])
        apart = np.bitwise_count(held[r - first] ^ held[at - first]).sum(1, dtype=np.int64)
        at = at[apart <= (1 - j) / (1 + j) * (n[r] + n[at]) + 0.001]
        done = 0
        while done < len(at):
            k = done + max(1, int(np.searchsorted(np.cumsum(n[at[done:]]), SLICE)))
            part, done = at[done:k], k
            flat = np.concatenate([sets[x] for x in part])
            hit = sets[r][np.minimum(np.searchsorted(sets[r], flat), n[r] - 1)] == flat
            both = np.add.reduceat(hit, np.r_[0, np.cumsum(n[part])[:-1]], dtype=np.int64)
            for x in part[100 * both >= percent * (n[r] + n[part] - both)]:
                if comp[x] != comp[r]:
                    comp[comp == comp[x]] = comp[r]
                    out.append((int(order[r]), int(order[x])))
    return out


def compare_cells(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) links of cells. rows: host, i, j, u, cls, label, items; u is i or j. Cells come sorted and are worked off as
    a stream, one at a time."""

    def one(table: pa.Table) -> pa.RecordBatch:
        i, u, cls, label = (table.column(c).to_numpy() for c in ("i", "u", "cls", "label"))
        items = table.column("items").combine_chunks()
        items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
        ends = items.offsets.to_numpy()
        flat = items.values.to_numpy()
        found = cell_links(label, (u != i).astype(np.int8), [flat[a:b] for a, b in zip(ends[:-1], ends[1:])], percent)
        x = cls[np.array(found, np.int64).reshape(-1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(x.min(1)), pa.array(x.max(1))], names=["a", "b"])

    def run(batches):
        for table in groups_of(batches, ("host", "i", "j")):
            yield one(table)

    dealt = rows.select("host", "i", "j", "u", "cls", "label", "items").repartition("host", "i", "j").sortWithinPartitions("host", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a, b = sets.select(F.col("cls").alias("a"), F.col("items").alias("items_a")), sets.select(F.col("cls").alias("b"), F.col("items").alias("items_b"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b").withColumn("i", F.size(F.array_intersect("items_a", "items_b")))
    return both.where(F.expr(f"100 * i >= {percent} * (size(items_a) + size(items_b) - i)")).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each distinct doc_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    every = scratch.table("sketches", sketches(docs, size, k))
    # classes of equal sets; the digest stands for the set. The least doc_id is found first, by two-step sums.
    heads = every.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("cls"), F.min("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = scratch.table("classes", heads)
    # inverted lists of retained values; values of one class only can't lead anywhere
    posts = classes.select("cls", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    shared = posts.groupBy("v").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    own = posts.join(shared, "v").groupBy("cls").agg(F.first("s").alias("s"), F.sort_array(F.collect_list(F.struct("f", "v"))).alias("hits"))
    # the rarest s - ceil(SHARE * s) + 1 values; those found nowhere else come first and need no list
    take = F.expr(f"greatest(0, s - cast(ceil({SHARE} * s) as int) + 1 - (s - size(hits)))")
    keyed = own.withColumn("keys", F.slice(F.col("hits.v"), F.lit(1), take)).where("size(keys) > 0").select("cls", "keys")
    keyed = scratch.table("keyed", keyed.join(classes.select("cls", "n"), "cls"))
    # rows that share a doc_id and differ: any of their sets may stand here; exact sizes are tested below
    reps = docs.select(F.col("doc_id").cast("long").alias("cls"), F.col("text").cast("string").alias("text"))
    sets = scratch.table("sets", full_sets(id_join(reps, keyed.select("cls"), "cls"), size))
    # the host of a list is the class with the smallest hash; lists of one class can't lead anywhere
    lists = keyed.select("cls", F.explode("keys").alias("v"))
    hosts = lists.groupBy("v").agg(F.min(F.struct(F.xxhash64("cls").alias("h"), "cls")).alias("host"), F.count(F.lit(1)).alias("m")).where("m > 1")
    member = lists.join(hosts.select("v", F.col("host.cls").alias("host")), "v").groupBy("cls", "host").agg(F.count(F.lit(1)).alias("shared"))
    member = scratch.table("member", member)

    # each class is verified against the host of most of its lists
    best = member.where("cls <> host").groupBy("cls").agg(F.max(F.struct("shared", "host")).alias("best"))
    links = scratch.table("links", _verified(best.select(F.col("cls").alias("a"), F.col("best.host").alias("b")), sets, percent))
    labels = scratch.table("labels", components(spark, links))

    # what the hosts left: groups of several labels, in cells
    named = member.join(labels, F.col("cls") == F.col("node"), "left").select("cls", "host", F.coalesce("component", "cls").alias("label"))
    named = scratch.table("named", named.join(keyed.select("cls", "n"), "cls"))
    parts = named.groupBy("host", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("items"))
    groups = parts.groupBy("host").agg(F.max(F.struct("m", "label", "items")).alias("top"), F.count(F.lit(1)).alias("labels"), F.sum("m").alias("m"), F.sum("items").alias("items")).where("labels > 1")
    blocks = lambda m, items: F.greatest(F.ceil(m / CELL), F.ceil(items / CELL_ITEMS)).cast("int")
    groups = groups.select("host", F.col("top.label").alias("main"), blocks(F.col("m") - F.col("top.m"), F.col("items") - F.col("top.items")).alias("rest"), blocks(F.col("top.m"), F.col("top.items")).alias("most"))
    rows = named.join(groups, "host")
    hashed = F.xxhash64("cls")
    inner = F.col("label") == F.col("main")
    rows = rows.select("cls", "label", "host", "rest", "most", F.when(inner, F.col("rest") + F.pmod(hashed, F.col("most"))).otherwise(F.pmod(hashed, F.col("rest"))).cast("int").alias("u"), inner.alias("inner"))
    rows = rows.withColumn("o", F.explode(F.expr("sequence(0, if(inner, rest, rest + most) - 1)")))
    rows = rows.select("cls", "label", "host", "u", F.least("u", "o").alias("i"), F.greatest("u", "o").alias("j"))
    links = scratch.table("all_links", links.union(compare_cells(rows.join(sets, "cls"), percent)))
    labels = scratch.table("all_labels", components(spark, links))
    scratch.drop("sets", "keyed", "member", "named", "links")

    classed = scratch.table("classed", classes.select("h1", "h2", "cls").join(labels, F.col("cls") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "cls").alias("component")))
    rows = every.groupBy("doc_id").agg(F.min(F.struct("n", "h1", "h2")).alias("z")).select("doc_id", "z.n", "z.h1", "z.h2")
    out = rows.join(classed, ["h1", "h2"], "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("component_id") == F.col("doc_id")).alias("kept"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id, min(r.root) = n.doc_id AS kept
FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""
