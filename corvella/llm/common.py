"""Shared helpers: shared-folder tables, bounded memo tables, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries a per-worker memo table holds before it is emptied; bounds a Python worker's memory.
MEMO_ENTRIES = 300_000
#: A set of 8-byte ids is broadcast up to this many entries (about 8 MB); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


class Memo(dict):
    """A dict that fills itself by ``make(key)`` and empties itself at ``limit`` entries."""

    def __init__(self, make, limit: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 64:  # long words are rare and would cost memory
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def groups_of(batches, keys: tuple[str, ...]):
    """The tables of rows with equal keys, which follow each other in the batches; one is held at a time."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        change = np.zeros(max(0, len(table) - 1), bool)
        for k in keys:
            change |= np.diff(table.column(k).to_numpy()) != 0
        cuts = np.flatnonzero(change) + 1
        for a, b in zip(np.r_[0, cuts[:-1]], cuts):
            yield table.slice(a, b - a)
        held = table.slice(cuts[-1] if len(cuts) else 0)  # may go on in the next batch
    if held is not None and len(held):
        yield held


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="corvella-"))
        root = sc._jsc.sc().getCheckpointDir().get()
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


class Scratch:
    """Tables written to the shared folder: they cut lineage, survive lost executors, and go when dropped or at exit."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_root(spark)}/scratch-{uuid.uuid4().hex}", {}

    def table(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        atexit.register(_remove, self.spark, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                _remove(self.spark, path)


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a scan, dealt anew where it has fewer splits than there are cores: a Parquet file can't be split within a
    row group, and the operators' Python work costs far more than moving the few rows of so few splits."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def id_join(big: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Join on one id column; broadcasts ``ids`` only after its row count was checked."""
    small = ids.count() <= BROADCAST_IDS
    return big.join(F.broadcast(ids) if small else ids, key, how)


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Connected components of ``edges`` (a long, b long) as (node, component): the smallest reachable id.

    Alternating large-star and small-star steps, all distributed; each round is checkpointed in the
    shared folder. Self loops vanish; a node without an edge to another node is not in the result.
    Repeated edges and either direction are fine. Rounds grow with the square of the logarithm of the nodes at most; a run
    that isn't done after ``max_rounds`` raises, as its labels would be wrong.
    """
    shared_root(spark)
    e = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct().checkpoint()
    before = None
    for _ in range(max_rounds):
        sym = e.union(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(low, "u").where("v > u and v <> m").select(F.col("m").alias("v"), F.col("v").alias("u")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(low, "u").select(F.col("m").alias("v"), F.explode(F.array("v", "u")).alias("u")).where("u <> v").distinct().checkpoint()
        # unchanged count and sums: every node hangs on one root and no further step moves it
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
