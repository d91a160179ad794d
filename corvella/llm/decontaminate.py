"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The test items are the small side. They are taken in blocks of about ``BLOCK_WORDS`` words, so the driver and each worker
hold one block's vocabulary and n-grams at a time, whatever the number of items; a block is two passes over the texts.
For a block:

1. One pass over the texts counts in how many documents each item n-gram occurs (sums per task, then a
   shuffle of n-gram numbers only).
2. Every n-gram of an item that some document holds is a seed, so any copied run of N words holds one.
3. A second pass finds seeds in the texts. Near hits of one item with at least ``min_seeds`` different seeds
   (or all it has; one for items of fewer than ``SHORT`` words) make a candidate window, and the alignment's score against
   that of the item with itself decides. A window that shares too few words with the item to reach the score is not
   aligned; one of more than ``CELLS`` cells is aligned within a band around the diagonals of its hits.

Words are lower case without punctuation. Cases: null or empty texts match nothing; items of fewer than N
words are compared by all their words in a row; repeated rows give repeated rows; a null doc_id is kept as
such; a null item_id is left out; equal rows of items count once; empty tables give an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.llm.common import documents
from corvella.llm.wordseq import Numberer, align, grams, words_of

N = 3
BLOCK_WORDS = 1_000_000
SHORT = 12
CELLS = 1 << 22


class _Items:
    def __init__(self, rows):
        self.items = [(r.item_id, w) for r in rows if (w := words_of(r.text))]
        self.vocab: dict[str, int] = {}
        for _, ws in self.items:
            for w in ws:
                self.vocab.setdefault(w, len(self.vocab) + 1)
        self.base = len(self.vocab) + 1
        self.ids = [np.array([self.vocab[w] for w in ws]) for _, ws in self.items]
        self.sizes = sorted({min(N, len(x)) for x in self.ids})
        self.grams = {n: np.unique(np.concatenate([grams(x, n, self.base) for x in self.ids if min(N, len(x)) == n])) for n in self.sizes}


def _counts(docs: DataFrame, it: _Items) -> dict[int, np.ndarray]:
    """In how many documents each n-gram occurs, for each n."""
    vocab, base, known = it.vocab, it.base, it.grams

    def run(batches):
        number, sums = Numberer(vocab), {n: np.zeros(len(g), np.int64) for n, g in known.items()}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                ids = number(t)
                for n, g in known.items():
                    found = np.unique(x[x >= 0]) if len(x := grams(ids, n, base)) else x
                    if len(found):
                        at = np.minimum(np.searchsorted(g, found), len(g) - 1)
                        sums[n][at[g[at] == found]] += 1
        for n, s in sums.items():
            k = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), n, np.int32)), pa.array(k), pa.array(s[k])], names=["n", "k", "c"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "n int, k long, c long").groupBy("n", "k").agg(F.sum("c").alias("c")).collect()
    out = {n: np.zeros(len(g), np.int64) for n, g in known.items()}
    for r in rows:
        out[r.n][r.k] = r.c
    return out


def _seeds(it: _Items, counts: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: the sorted seeds, where the places of each begin, and the item and position of each place."""
    out = {}
    for n in it.sizes:
        some = [i for i, ids in enumerate(it.ids) if min(N, len(ids)) == n]
        per = [grams(it.ids[i], n, it.base) for i in some]
        g, item = np.concatenate(per), np.repeat(some, [len(x) for x in per])
        at = np.concatenate([np.arange(len(x)) for x in per])
        held = counts[n][np.searchsorted(it.grams[n], g)] > 0
        g, item, at = g[held], item[held], at[held]
        order = np.argsort(g, kind="stable")
        keys, first = np.unique(g[order], return_index=True)
        out[n] = keys, np.r_[first, len(g)], item[order], at[order]
    return out


def matches(docs: DataFrame, benchmark: DataFrame, min_score: float = 0.5, min_seeds: int = 2, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score, matched, n_words, start_word, end_word): the best alignment of each contaminated pair."""
    schema = "doc_id long, item_id long, score double, matched long, n_words long, start_word long, end_word long"
    spark, out, last = docs.sparkSession, None, None
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    mean = items.agg(F.avg(F.length("text"))).first()[0] or 1
    block = max(1, int(block_words * 6 / mean))  # items of about so many words
    while True:
        # by (item_id, text), so that items which share an id don't have to come together
        more = items if last is None else items.where((F.col("item_id") > last[0]) | (F.col("item_id") == last[0]) & (F.col("text") > F.lit(last[1])))
        rows = more.orderBy("item_id", "text").limit(block).collect()
        if not rows:
            break
        last = rows[-1].item_id, rows[-1].text
        it = _Items(rows)
        if it.items:
            found = _block(docs, it, min_score, min_seeds, schema)
            out = found if out is None else out.union(found)
        if len(rows) < block:
            break
    return spark.createDataFrame([], schema) if out is None else out


def _bands(diagonals: np.ndarray, n: int, m: int) -> list[tuple[int, int] | None]:
    """The bands to align in: none for a small table, else around the hits, in overlapping pieces of CELLS cells."""
    if n * m <= CELLS:
        return [None]
    slack = max(8, n // 16)
    width, d = max(4 * slack, CELLS // n), np.unique(diagonals)
    out, k = [], 0
    while k < len(d):
        low = int(d[k]) - slack
        out.append((low, min(low + width, int(d[-1]) + slack)))
        k = max(k + 1, int(np.searchsorted(d, low + width - 2 * slack)))
    return out


def _block(docs: DataFrame, it: _Items, min_score: float, min_seeds: int, schema: str) -> DataFrame:
    seeds = _seeds(it, _counts(docs, it))
    vocab, base, words, names = it.vocab, it.base, it.ids, [i for i, _ in it.items]
    need = np.zeros(len(words), np.int64)
    for keys, cuts, item, _ in seeds.values():
        pairs = np.unique(np.stack([item, np.repeat(np.arange(len(keys)), np.diff(cuts))]), axis=1)
        need += np.bincount(pairs[0], minlength=len(words))
    need = np.minimum(need, np.where([len(x) < SHORT for x in words], 1, min_seeds))
    bags = [np.unique(x, return_counts=True) for x in words]

    def shared(ids: np.ndarray, bag: tuple[np.ndarray, np.ndarray]) -> int:
        """How many words of an item the text can match, each as often as both hold it."""
        at = np.minimum(np.searchsorted(bag[0], ids), len(bag[0]) - 1)
        return int(np.minimum(np.bincount(at[bag[0][at] == ids], minlength=len(bag[0])), bag[1]).sum())

    def best(ids: np.ndarray, place: np.ndarray, seed: np.ndarray, pos: np.ndarray, k: int):
        """place: the sorted places of hits of item k; seed: their seeds' numbers; pos: their positions in the item."""
        item, top = words[k], None
        cuts = np.flatnonzero(np.diff(place) > len(item)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)]):
            if b - a >= need[k] and len(set(seed[a:b].tolist())) >= need[k]:
                begin = place[a:b] - pos[a:b]
                low = max(0, int(begin.min()) - len(item) // 2)
                high = int(begin.max()) + len(item) + len(item) // 2
                # a long row of hits is aligned in overlapping pieces, so one alignment stays small
                for s in range(low, max(low + 1, high - 2 * len(item)), 2 * len(item)) if high - low > 6 * len(item) else (low,):
                    e = min(high, s + 4 * len(item)) if high - low > 6 * len(item) else high
                    most = 2 * shared(ids[s:e], bags[k])
                    if most < min_score * 2 * len(item) or top and most <= top[0]:
                        continue  # no alignment here can decide
                    for band in _bands(begin[(begin > s - len(item)) & (begin < e)] - s, len(item), len(ids[s:e])):
                        score, n, _, _, j, end = align(item, ids[s:e], band)
                        if top is None or score > top[0]:
                            top = (score, n, s + j, s + end)
        return top

    def run(batches):
        number = Numberer(vocab)
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, hits = number(t), []
                for n, (keys, cuts, item, pos) in seeds.items():
                    g = grams(ids, n, base)
                    if not len(g) or not len(keys):
                        continue
                    at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                    place = np.flatnonzero(keys[at] == g)
                    if not len(place):
                        continue
                    seed = at[place]
                    size = cuts[seed + 1] - cuts[seed]
                    row = np.repeat(cuts[seed] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                    hits.append((item[row], np.repeat(place, size), np.repeat(seed, size), pos[row]))
                if not hits:
                    continue
                item, place, seed, pos = (np.concatenate(x) for x in zip(*hits))
                enough = np.bincount(item, minlength=len(words))[item] >= need[item]
                item, place, seed, pos = item[enough], place[enough], seed[enough], pos[enough]
                order = np.argsort(item, kind="stable")  # places stay sorted, as an item has grams of one size
                item, place, seed, pos = item[order], place[order], seed[order], pos[order]
                cuts = (np.flatnonzero(np.diff(item)) + 1).tolist()
                for a, b in zip([0, *cuts], [*cuts, len(item)]) if len(item) else ():
                    i = int(item[a])
                    top = best(ids, place[a:b], seed[a:b], pos[a:b], i)
                    if top and top[0] >= min_score * 2 * len(words[i]):
                        for column, v in zip(out, (doc, names[i], top[0] / (2 * len(words[i])), top[1], len(words[i]), top[2], top[3])):
                            column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "item_id", "score", "matched", "n_words", "start_word", "end_word"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
