"""Near-duplicate vectors by an epsilon grid order (EGO) join on the cosine.

Unit vectors at cosine c lie sqrt(2 - 2c) apart, so the join radius is eps = sqrt(2 - 2 * threshold).
Vectors are rotated to their principal dimensions, put into grid cells of width eps on the leading ones and
sorted by cell. The sequence is cut into chunks by its numbers, whatever partitions it is in, each with a bounding box in all
dimensions. Chunks meet by an equal-key join on neighbouring cells of the first two dimensions, less those whose boxes are
further apart than eps, and the pairs are dealt in blocks, so that a chunk is sent once for a block of pairs.
Within a pair of chunks the sequence intervals are halved recursively, and blocks that are provably
distant are skipped; what is left is multiplied in single precision and decided in double precision on
the vectors as given. Where that is within 1e-12 of the threshold, the exact cosine decides, rounded once to a double.

Equal vectors are one class before the join and count by their number, so a group of copies costs one row.
Links between different vectors are counted inside a block and never written out; each block gives a
spanning forest of its links, and these feed distributed connected components.

Cases: vectors that are null, empty, all zero or hold null or non-finite parts link with nothing; vectors
of different lengths never link; rows that share a vec_id are one vector, the smallest; a null vec_id is
left out; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.llm.common import Scratch, components, groups_of

#: Numbers that a chunk's vectors hold together, about.
CHUNK = 1 << 18
LEAF = 512
CELL_DIMS = 6
#: A side of a block of pairs has so many chunks at most; with few chunks fewer, so that there are some hundred blocks.
SIDE = 16


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _bases(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the rotation to principal dimensions; the driver gets length * length sums each."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims):
                x = _unit(_matrix(batch.column(1).filter(pa.array(dims == d))))
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, g in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([int(d)], pa.int32()), pa.array([g.ravel()], pa.list_(pa.float64()))], names=["dim", "g"])

    parts = classes.select("dim", "vec").mapInArrow(run, "dim int, g array<double>")
    rows = parts.select("dim", F.posexplode("g")).groupBy("dim", "pos").agg(F.sum("col").alias("s")).collect()
    out = {}
    for d in {r.dim for r in rows}:
        g = np.zeros(d * d)
        for r in rows:
            if r.dim == d:
                g[r.pos] = r.s
        values, vectors = np.linalg.eigh(g.reshape(d, d))
        out[d] = np.ascontiguousarray(vectors[:, ::-1])
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the given links connect, at most one for each node."""
    nodes, flat = np.unique(np.r_[a, b], return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        low = low[low]
        if (low == label).all():
            break
        label = low
    keep = label != np.arange(len(nodes))
    return nodes[label[keep]], nodes[keep]


def _reaches(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether the exact cosine, rounded once to a double, is at least the threshold."""
    a, b = ([Fraction(v) for v in z.tolist()] for z in (x, y))
    dot = sum(p * q for p, q in zip(a, b))
    least = (Fraction(threshold) + Fraction(math.nextafter(threshold, 0))) / 2
    return dot > 0 and dot * dot >= least * least * sum(p * p for p in a) * sum(q * q for q in b)


def join_blocks(x, y, same: bool, rotation: np.ndarray, threshold: float):
    """Yields (i, j): the linked pairs of each leaf block of two sequences; for ``same`` only i < j."""
    eps2 = 2 - 2 * threshold + 1e-9
    ux, uy = _unit(x), _unit(y)
    px = (ux @ rotation).astype(np.float32)
    py = px if same else (uy @ rotation).astype(np.float32)

    def boxes(p):
        cuts = range(0, len(p), LEAF)
        return np.array([p[c : c + LEAF].min(0) for c in cuts]), np.array([p[c : c + LEAF].max(0) for c in cuts])

    (xlo, xhi), (ylo, yhi) = boxes(px), boxes(py)

    def visit(a, b, c, d):
        if same and a > d - 1:
            return
        gap = np.maximum(0, np.maximum(ylo[c:d].min(0) - xhi[a:b].max(0), xlo[a:b].min(0) - yhi[c:d].max(0)) - 1e-5)
        if float(gap @ gap) > eps2:
            return
        if b - a == 1 and d - c == 1:
            i0, j0 = a * LEAF, c * LEAF
            near = px[i0 : i0 + LEAF] @ py[j0 : j0 + LEAF].T >= threshold - 1e-4
            if same and a == c:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            for s in range(0, len(i), 1 << 15):
                p, q = i[s : s + (1 << 15)] + i0, j[s : s + (1 << 15)] + j0
                cosine = np.einsum("ij,ij->i", ux[p], uy[q])
                ok = cosine >= threshold
                for k in np.flatnonzero(np.abs(cosine - threshold) < 1e-12):
                    ok[k] = _reaches(x[p[k]], y[q[k]], threshold)
                yield p[ok], q[ok]
            return
        halves = lambda lo, hi: [(lo, hi)] if hi - lo == 1 else [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
        for p in halves(a, b):
            for q in halves(c, d):
                yield from visit(*p, *q)

    if len(x) and len(y):
        yield from visit(0, len(xlo), 0, len(ylo))


def ego_join(vectors: DataFrame, threshold: float = 0.9, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each distinct vec_id."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    eps = (2 - 2 * threshold) ** 0.5
    kind = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    width = np.float32 if kind == "float" else np.float64
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vec"))
    rows = rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    fine = F.expr(f"coalesce(forall(vec, x -> x is not null and not isnan(x) and abs(x) < cast('Infinity' as {kind})) and exists(vec, x -> x <> 0), false)")
    rows = scratch.table("rows", rows.withColumn("fine", fine).withColumn("h1", F.when(F.col("fine"), F.xxhash64("vec"))).withColumn("h2", F.when(F.col("fine"), F.xxhash64(F.lit(7), "vec"))))
    classes = rows.where("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    classes = scratch.table("classes", classes.withColumn("dim", F.size("vec")))
    bases = _bases(classes)

    def cells(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            keys = np.zeros((len(dims), CELL_DIMS), np.int32)
            for d in np.unique(dims):
                at = dims == d
                p = _unit(_matrix(batch.column(3).filter(pa.array(at)))) @ bases[d][:, :CELL_DIMS]
                keys[at, : p.shape[1]] = np.floor(p / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(keys[:, i].copy()) for i in range(CELL_DIMS)]], names=["rep", "copies", "dim", "vec", *names])

    names = [f"c{i}" for i in range(CELL_DIMS)]
    placed = classes.select("rep", "copies", "dim", "vec").mapInArrow(cells, f"rep long, copies long, dim int, vec array<{kind}>, " + ", ".join(f"{n} int" for n in names))
    ordered = placed.repartitionByRange("dim", *names, "rep").sortWithinPartitions("dim", *names, "rep").withColumn("at", F.monotonically_increasing_id())
    ordered = scratch.table("ordered", ordered)
    # chunks by the number in the whole sequence; the driver gets a row for each partition and vector length
    part = F.shiftright("at", 33)
    runs = ordered.groupBy("dim", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).orderBy("dim", "part").collect()
    starts, base, done, before = [], 0, 0, None
    for r in runs:
        if r["dim"] != before:
            base, done, before = base - -done // max(1, chunk // before) if before else 0, 0, r["dim"]
        starts.append((r["dim"], r["part"], base, done - r["first"]))
        done += r["n"]
    count = base - -done // max(1, chunk // before) if before else 0
    side = max(1, min(SIDE, count // 16))
    starts = F.broadcast(spark.createDataFrame(starts, "dim int, part long, base long, shift long"))
    cut = (F.col("base") + F.floor((F.col("at") + F.col("shift")) / F.greatest(F.lit(1), F.floor(F.lit(chunk) / F.col("dim"))))).cast("long")
    numbered = ordered.withColumn("part", part).join(starts, ["dim", "part"]).select("rep", "copies", "dim", "vec", "c0", "c1", "at", cut.alias("chunk"))

    def pack(batches):
        for table in groups_of(batches, ("chunk",)):
            table = table.combine_chunks()
            d, x = table.column("dim")[0].as_py(), _matrix(table.column("vec").combine_chunks()).astype(width)
            p = _unit(x.astype(np.float64)) @ bases[d]
            cells = [table.column(c).to_numpy() for c in ("c0", "c1")]
            values = [table.column("chunk")[0].as_py(), d, *[int(f(c)) for c in cells for f in (np.min, np.max)], p.min(0), p.max(0), table.column("rep").to_numpy().tobytes(), table.column("copies").to_numpy().tobytes(), x.tobytes()]
            kinds = [pa.int64(), *[pa.int32()] * 5, pa.list_(pa.float64()), pa.list_(pa.float64()), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["chunk", "dim", "low0", "high0", "low1", "high1", "lo", "hi", "ids", "copies", "data"])

    packed = numbered.repartition("chunk").sortWithinPartitions("chunk", "at").mapInArrow(pack, "chunk long, dim int, low0 int, high0 int, low1 int, high1 int, lo array<double>, hi array<double>, ids binary, copies binary, data binary")
    chunks = scratch.table("chunks", packed)
    meta = chunks.select("chunk", "dim", "low0", "high0", "low1", "high1", "lo", "hi")

    def in_cells(name: str, reach: int) -> DataFrame:
        out = meta.select(F.col("chunk").alias(name), "dim", F.explode(F.sequence(F.col("low0") - reach, F.col("high0") + reach)).alias("x"), "low1", "high1", F.col("lo").alias(f"{name}lo"), F.col("hi").alias(f"{name}hi"))
        return out.select(name, "dim", "x", F.explode(F.sequence(F.col("low1") - reach, F.col("high1") + reach)).alias("y"), f"{name}lo", f"{name}hi")

    gap = F.expr("aggregate(zip_with(zip_with(alo, bhi, (p, q) -> p - q), zip_with(blo, ahi, (p, q) -> p - q), (p, q) -> greatest(0d, p, q)), 0d, (s, g) -> s + g * g)")
    pairs = in_cells("a", 0).join(in_cells("b", 1), ["dim", "x", "y"]).where("a <= b").where(gap <= eps * eps + 1e-9).select("a", "b").distinct()
    block = lambda c: F.floor(F.col(c) / side).cast("long")
    pairs = scratch.table("pairs", pairs.select(block("a").alias("i"), block("b").alias("j"), "a", "b"))

    def matched(batches):
        empty = np.zeros(0, np.int64)
        for table in groups_of(batches, ("i", "j")):
            held, wanted = {}, []
            for r in table.select(["a", "b", "dim", "ids", "copies", "data"]).to_pylist():
                if r["data"] is None:
                    wanted.append((r["a"], r["b"]))
                else:
                    held[r["a"]] = r["dim"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["copies"], np.int64), np.frombuffer(r["data"], width).reshape(-1, r["dim"])
            links = {k: np.zeros(len(v[1]), np.int64) for k, v in held.items()}
            ea, eb = [], []
            for a, b in sorted(wanted):
                (d, ids_a, copies_a, x), (_, ids_b, copies_b, y) = held[a], held[b]
                for i, j in join_blocks(x.astype(np.float64), y.astype(np.float64), a == b, bases[d], threshold):
                    np.add.at(links[a], i, copies_b[j])
                    np.add.at(links[b], j, copies_a[i])
                    u, v = _forest(ids_a[i], ids_b[j])
                    ea.append(u)
                    eb.append(v)
            u, v = _forest(np.concatenate([empty, *ea]), np.concatenate([empty, *eb]))
            sums = [(held[k][1][m > 0], m[m > 0]) for k, m in links.items()]
            first = np.concatenate([u, *[z for z, _ in sums]])
            second = np.concatenate([v, *[np.zeros(len(z), np.int64) for z, _ in sums]])
            counts = np.concatenate([np.zeros(len(u), np.int64), *[m for _, m in sums]])
            yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(counts)], names=["a", "b", "links"])

    # each block gets its pairs and, once each, the chunks that they name
    no = lambda kind: F.lit(None).cast(kind)
    asked = pairs.select("i", "j", F.explode(F.array("a", "b")).alias("chunk")).distinct()
    sent = asked.join(chunks.select("chunk", "dim", "ids", "copies", "data"), "chunk").select("i", "j", F.col("chunk").alias("a"), no("long").alias("b"), "dim", "ids", "copies", "data")
    both = sent.union(pairs.select("i", "j", "a", "b", no("int").alias("dim"), no("binary").alias("ids"), no("binary").alias("copies"), no("binary").alias("data")))
    both = both.repartition("i", "j").sortWithinPartitions("i", "j")
    found = scratch.table("found", both.mapInArrow(matched, "a long, b long, links long"))
    labels = components(spark, found.where("links = 0").select("a", "b"))
    counts = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    named = classes.select("h1", "h2", "rep", "copies").join(counts, F.col("rep") == F.col("a"), "left").join(labels, F.col("rep") == F.col("node"), "left")
    named = scratch.table("named", named.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component")))
    out = rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(node, root) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b)
SELECT r.node AS vec_id, (SELECT count(*) FROM l WHERE l.a = r.node) AS n_links, min(r.root) AS component_id, min(r.root) = r.node AS kept
FROM r GROUP BY r.node
"""
