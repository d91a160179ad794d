"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades are the labels' own: each value of ``toxic`` above 0 that the sample holds is one, in order. Labels of only 0 and 1 say
nothing of severity; then grade 2 stands for toxic documents with more telling words, by log(1 + count), than the median
of the toxic sample. One weight vector w is shared by all thresholds t1 < t2 < ...: P(grade >= k) = sigmoid(w.x - t_k), and the
expected severity is the sum of these. A document is rejected when its expected severity reaches ``REJECT``.

Features are words and word beginnings of 4 and 5 letters (lower case, letters and digits), each with
log(1 + count). Up to ``FEATURES`` telling ones by chi-square are kept.

Fitting reads a bounded sample: at most ``TOXIC`` toxic and ``CLEAN`` other labelled documents with the smallest
hashes of doc_id, equal texts once. Workers count their features, so the driver holds numbers of features
that ``LEAST_DOCS`` toxic texts share and no text. Scoring reads every whole text, one pass and no shuffle.

Cases: null or empty text has no features and gets the severity of the thresholds alone; labels that are
null or name no document are ignored; without both kinds of label every severity is 0 and nothing is
rejected; rows that share a doc_id are scored each; empty tables give an empty table; extra columns are
ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvella.llm.common import Memo, Scratch, documents
from corvella.llm.wordseq import normal

TOXIC, CLEAN = 1_200, 2_400
FEATURES = 500
LEAST_DOCS = 4
#: A feature counts if toxic documents hold it this many times as often, with at least this chi-square.
TELLING, LEAST_CHI = 6, 12
#: A toxic document is explained once it holds this many chosen features.
COVER = 3
REJECT = 0.5


def features_of(word: str) -> tuple[str, ...]:
    """The word itself and its beginnings."""
    return (word, *[f"{word[:k]}*" for k in (4, 5) if len(word) > k]) if word else ()


class OrdinalModel:
    def __init__(self, index: dict[str, int], weights: np.ndarray, thresholds: np.ndarray):
        self.index, self.weights, self.thresholds = index, weights, thresholds

    def scorer(self):
        """A function of a text that gives P(>= k) for each grade k."""
        index, weights, cuts = self.index, self.weights, self.thresholds
        memo = Memo(lambda c: tuple(i for f in features_of(normal(c)) if (i := index.get(f)) is not None))

        def score(text: str | None) -> np.ndarray:
            if not len(weights):
                return np.zeros(len(cuts))
            found = Counter(i for t in map(memo.__getitem__, (text or "").lower().split()) if t for i in t)
            s = sum(weights[i] * np.log1p(c) for i, c in found.items())
            return 1 / (1 + np.exp(-np.clip(s - cuts, -50, 50)))

        return score


def _select(bags: list[np.ndarray], y: np.ndarray, vocab: list[str]) -> np.ndarray:
    """Telling features, the most telling first, until COVER of them are in each toxic document that can be explained.

    bags: each document's features as numbers of the sorted ``vocab``. Toxic documents that hold COVER chosen
    features no longer count, so chance words, which are many in so long a tail, find no documents left that
    would make them look telling.
    """
    toxic = np.flatnonzero(y == 1)
    feature, row = np.concatenate([bags[r] for r in toxic]), np.repeat(toxic, [len(bags[r]) for r in toxic])
    order = np.argsort(feature, kind="stable")
    cuts = np.searchsorted(feature[order], np.arange(len(vocab) + 1))
    held = [row[order[i:j]] for i, j in zip(cuts[:-1], cuts[1:])]
    b = np.bincount(np.concatenate([bags[r] for r in np.flatnonzero(y == 0)]), minlength=len(vocab)).astype(float)
    # features of the same documents (a word and its beginning) count once, by the shortest
    once: dict[tuple, int] = {}
    for f in sorted(range(len(vocab)), key=lambda f: (len(vocab[f]), f)):
        if len(held[f]) >= LEAST_DOCS:
            once.setdefault((b[f], held[f].tobytes()), f)
    open_ = np.zeros(len(vocab), bool)
    open_[list(once.values())] = True
    a = np.array([len(h) for h in held], float)
    p, n, cover, out = int(y.sum()), int((y == 0).sum()), np.zeros(len(y), int), []
    while open_.any() and len(out) < FEATURES:
        chi = (p + n) * (a * (n - b) - b * (p - a)) ** 2 / np.maximum(1, (a + b) * (p + n - a - b) * p * n)
        chi[~open_ | (a * n <= TELLING * b * p)] = 0
        f = len(chi) - 1 - int(np.argmax(chi[::-1]))
        if chi[f] <= LEAST_CHI:
            break
        out.append(f)
        open_[f] = False
        for r in held[f]:
            cover[r] += 1
            if cover[r] == COVER:
                a[bags[r]] -= 1
    return np.array(out, int)


def fit(vocab: list[str], bags: list[tuple[np.ndarray, np.ndarray]], toxic: list[int], steps: int = 400, rate: float = 1.0) -> OrdinalModel:
    """bags: for each document the numbers of its features in the sorted ``vocab``, each once, and their counts."""
    label = np.array(toxic)
    y = (label > 0).astype(int)
    if not len(y) or y.min() == y.max():
        return OrdinalModel({}, np.zeros(0), np.zeros(2))
    p, n = int(y.sum()), int(len(y) - y.sum())
    chosen = _select([ids for ids, _ in bags], y, vocab)
    index = {vocab[f]: i for i, f in enumerate(chosen)}
    place = np.full(len(vocab), -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(bags), len(chosen)))
    for r, (ids, counts) in enumerate(bags):
        at = place[ids]
        x[r, at[at >= 0]] = np.log1p(counts[at >= 0])
    levels = np.unique(label[y == 1])
    if len(levels) > 1:
        grade, top = np.where(y == 1, np.searchsorted(levels, label) + 1, 0), len(levels)
    else:
        strength = x.sum(1).round(9)  # so that rounding does not part equal ones at the median
        grade, top = np.where(y == 0, 0, np.where(strength > np.median(strength[y == 1]), 2, 1)), 2
    # gradient descent with momentum on the mean log loss; t_k+1 = t_k + exp(g_k) keeps the order
    # weights stay at or above 0, as only telling features were kept
    w, t1, g, v, l2 = np.ones(len(chosen)), 1.0, np.zeros(top - 1), 0, 1e-4
    weight = np.where(y == 1, 0.5 / p, 0.5 / n)[:, None]
    own, next_ = grade[:, None] == np.arange(1, top + 1), grade[:, None] == np.arange(top)
    for _ in range(steps):
        cuts = t1 + np.r_[0, np.cumsum(np.exp(g))]
        pr = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - cuts, -50, 50)))
        # derivatives of the log of P(>= k) - P(>= k + 1), k a document's grade, by the score under each threshold
        all_ = np.c_[np.ones(len(x)), pr, np.zeros(len(x))]
        mid = np.maximum(all_[np.arange(len(x)), grade] - all_[np.arange(len(x)), grade + 1], 1e-9)[:, None]
        slope = pr * (1 - pr) / mid
        slope[:, -1] = np.where(own[:, -1], 1 - pr[:, -1], slope[:, -1])  # these two have simpler forms
        down = np.where(next_, slope, 0)
        down[:, 0] = np.where(next_[:, 0], pr[:, 0], 0)
        d = (np.where(own, slope, 0) - down) * weight
        grad = np.r_[x.T @ d.sum(1) - l2 * w, -d.sum(), -np.cumsum(d.sum(0)[::-1])[::-1][1:] * np.exp(g)]
        v = 0.9 * v + grad
        w, t1, g = np.maximum(0, w + rate * v[: len(w)]), t1 + rate * v[len(w)], np.clip(g + rate * v[len(w) + 1 :], -5, 5)
    return OrdinalModel(index, w, t1 + np.r_[0, np.cumsum(np.exp(g))])


def train(docs: DataFrame, labels: DataFrame) -> OrdinalModel:
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda rows, n: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    # at most TOXIC + CLEAN ids, so the broadcast has a fixed bound
    sample = pick(known.where("toxic > 0"), TOXIC).union(pick(known.where("toxic <= 0"), CLEAN))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").where("text is not null")
    # equal texts once, by their smallest doc_id
    scratch = Scratch(docs.sparkSession)
    texts = scratch.table("sample", texts.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.min_by("toxic", "doc_id").alias("toxic")))

    def features(batches):
        of = Memo(lambda c: features_of(normal(c)))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([f for t in batch.column(0).to_pylist() for f in {f for c in {*t.lower().split()} for f in of[c]}], pa.string())], names=["f"])

    # only features that enough toxic texts hold can be chosen, so nothing else comes to the driver
    often = texts.where("toxic > 0").select("text").mapInArrow(features, "f string").groupBy("f").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= LEAST_DOCS)
    vocab = sorted(r.f for r in often.select("f").toLocalIterator())
    number = {f: i for i, f in enumerate(vocab)}

    def count(batches):
        of = Memo(lambda c: tuple(i for f in features_of(normal(c)) if (i := number.get(f)) is not None))
        for batch in batches:
            ids, counts = [], []
            for t in batch.column(2).to_pylist():
                bag = sorted(Counter(i for c in t.lower().split() for i in of[c]).items())
                ids.append(np.array([i for i, _ in bag], "<i4").tobytes())
                counts.append(np.array([c for _, c in bag], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "toxic", "ids", "counts"])

    rows = sorted(texts.select("doc_id", "toxic", "text").mapInArrow(count, "doc_id long, toxic int, ids binary, counts binary").collect())
    scratch.drop("sample")
    return fit(vocab, [(np.frombuffer(r.ids, "<i4"), np.frombuffer(r.counts, "<i4")) for r in rows], [r.toxic for r in rows])


def score(docs: DataFrame, model: OrdinalModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, severity (0 to the number of grades), grade, rejected."""
    out = T.StructType([*docs.select(*keep).schema.fields, T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("rejected", T.BooleanType())])
    n = len(keep)

    def run(batches):
        of = model.scorer()
        for batch in batches:
            p = np.array([of(t) for t in batch.column(n).to_pylist()]).reshape(-1, len(model.thresholds))
            severity = p.sum(1)
            grade = np.argmax(-np.diff(np.c_[np.ones(len(p)), p, np.zeros(len(p))], axis=1), axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(severity), pa.array(grade), pa.array(severity >= REJECT)], names=out.names)

    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, out)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
