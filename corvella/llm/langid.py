"""Language identification by a linear-chain conditional random field over the words of a text.

Each run without white space is a word; its emission scores are sums of learned weights of affix, n-gram,
word and lexicon features that the sample showed. Learned transitions tie neighbouring words, and
forward-backward gives each word's label probabilities, also where a text switches languages. A text's
language is the one with the largest mean probability over its words with letters; score is that mean.

Training maximises the CRF likelihood on a bounded sample: about ``PER_LANGUAGE`` different documents of each language
among those with crc32(doc_id as text) mod 3 <> 1, a language and at most ``SAMPLE_CHARS`` code points, by the smallest hashes,
for each of at most ``MAX_LANGUAGES`` languages by frequency. Spans of different languages are spliced into code-switched
sequences, so that transitions are learned too. Lang, source and doc_id are no input of a prediction.

Forward-backward is exact on whole texts: words are cut into blocks of ``BLOCK``, every block's transfer matrix
is made in step with all others, block products give the messages at block borders, and a second pass fills in
the words between.

Cases: a language of longer documents only isn't learned; null texts and texts without a letter give ``und`` and score 0; without any language to learn from
every text does; a held-out row is scored like any other; a null doc_id is not held out; extra columns are
ignored; repeated rows give repeated rows; empty tables give an empty table.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvella.llm.common import documents

PER_LANGUAGE = 150
MAX_LANGUAGES = 256
SAMPLE_CHARS = 100_000
#: Different runs a worker holds before it starts anew.
RUNS = 400_000
LEXICON = 200
BLOCK = 32
#: With more languages than these, transfer matrices cost more than going through the texts in step.
FEW = 24
_LETTERS = re.compile(r"[^\W\d_]+")


def _letters(chunk: str) -> str:
    return chunk if chunk.isalpha() else "".join(_LETTERS.findall(chunk))


def features_of(word: str, lexicon: dict[str, tuple[int, ...]]) -> list[str]:
    """Word, affix, n-gram and lexicon features of the letters of a lower-case word."""
    padded = f"<{word}>"
    out = [padded[i : i + 3] for i in range(len(padded) - 2)]
    out += ("w" + word, "p" + word[:2], "q" + word[:3], "s" + word[-2:], "t" + word[-3:], "u" + word[-4:])
    if word in lexicon:
        out += [f"l{x}" for x in lexicon[word]]
    return out


def _norm(m: np.ndarray, axes) -> np.ndarray:
    return m / np.maximum(m.sum(axes, keepdims=True), 1e-300)


def marginals(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Label probabilities of each word. emission: exp scores of all texts' words one after another."""
    k = emission.shape[1]
    if k > FEW:
        return _in_step(emission, lengths, trans)
    per = -(-lengths // BLOCK)
    blocks, starts = int(per.sum()), np.r_[0, np.cumsum(lengths)[:-1]]
    if not blocks:
        return emission[:0]
    # words laid out as (block, step); steps behind a text's end hold ones and an identity transition
    first = np.repeat(np.r_[0, np.cumsum(per)[:-1]], per)
    nth = np.arange(blocks) - first
    begin = np.repeat(starts, per) + nth * BLOCK
    size = np.minimum(BLOCK, np.repeat(lengths, per) - nth * BLOCK)
    step = np.arange(BLOCK)
    used = step[None, :] < size[:, None]
    place = np.minimum(begin[:, None] + step[None, :], len(emission) - 1)
    e = np.where(used[:, :, None], emission[place], 1.0)
    # transfer matrices: from the label before the block to the label of its last word
    m = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(BLOCK):
        new = (m @ trans) * e[:, t, None, :]
        m = np.where(used[:, t, None, None], _norm(new, (1, 2)), m)
    # messages at block borders, text by text in step
    left, right = np.zeros((blocks, k)), np.zeros((blocks, k))
    order = np.argsort(-per, kind="stable")
    head = np.r_[0, np.cumsum(per)[:-1]][order]
    count = per[order]
    v, u = np.full((len(per), k), 1.0 / k), np.full((len(per), k), 1.0 / k)
    for t in range(int(per.max())):
        live = int(np.searchsorted(-count, -t, side="left"))
        at = head[:live] + t
        left[at] = v[:live]
        v[:live] = _norm((v[:live, None, :] @ m[at])[:, 0], 1)
        at = head[:live] + count[:live] - 1 - t
        right[at] = u[:live]
        u[:live] = _norm((m[at] @ u[:live, :, None])[:, :, 0], 1)
    alpha = np.empty((blocks, BLOCK, k))
    a = left
    for t in range(BLOCK):
        a = np.where(used[:, t, None], _norm((a @ trans) * e[:, t], 1), a)
        alpha[:, t] = a
    b = right
    out = np.empty_like(alpha)
    for t in range(BLOCK - 1, -1, -1):
        out[:, t] = _norm(alpha[:, t] * b, 1)
        b = np.where(used[:, t, None], _norm((e[:, t] * b) @ trans.T, 1), b)
    return out[used]


def _in_step(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The same, word by word through all texts at once; the longest come first, so that those still going on are a slice."""
    order = np.argsort(-lengths, kind="stable")
    size, begin = lengths[order], np.r_[0, np.cumsum(lengths)[:-1]][order]
    alpha, k = np.empty_like(emission), emission.shape[1]
    longest = int(size.max(initial=0))
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]  # texts of more than t words
    a = np.full((len(size), k), 1.0 / k)
    for t in range(longest):
        at = begin[: live[t]] + t
        a[: live[t]] = _norm((a[: live[t]] @ trans) * emission[at], 1)
        alpha[at] = a[: live[t]]
    b = np.ones((len(size), k))
    for t in range(longest - 1, -1, -1):
        at = begin[: live[t]] + t
        now = emission[at] * b[: live[t]]
        alpha[at] = _norm(alpha[at] * b[: live[t]], 1)
        b[: live[t]] = _norm(now @ trans.T, 1)
    return alpha


class Crf:
    def __init__(self, languages: list[str], index: dict[str, int], weights: np.ndarray, trans: np.ndarray, lexicon: dict[str, tuple[int, ...]]):
        self.languages, self.index, self.weights, self.trans, self.lexicon = languages, index, weights, trans, lexicon

    def predictor(self):
        """A function of a list of texts that gives their (language, score)."""
        index, lexicon, trans, k = self.index, self.lexicon, np.exp(self.trans), len(self.languages)
        weights = np.vstack([self.weights, np.zeros((1, k))])
        numbers: dict[str, int] = {}  # runs of this worker, each with a row of the table; 0: no letter
        table, used = np.ones((1 << 16, k)), 1

        def learn(new):
            nonlocal table, used
            rows, feats, sizes = [], [], []
            for c in new:
                if not (word := _letters(c)):
                    numbers[c] = 0
                    continue
                f = [i for x in features_of(word, lexicon) if (i := index.get(x)) is not None] or [-1]
                rows.append(c)
                feats += f
                sizes.append(len(f))
            if rows:
                s = np.add.reduceat(weights[feats], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
                while used + len(rows) > len(table):
                    table = np.vstack([table, np.ones_like(table)])
                table[used : used + len(rows)] = np.exp(np.clip(s - s.max(1, keepdims=True), -30, 0))
                numbers.update(zip(rows, range(used, used + len(rows))))
                used += len(rows)

        def predict(texts):
            nonlocal table, used
            if len(numbers) > RUNS:
                numbers.clear()
                used = 1
            chunks = [(t or "").lower().split() for t in texts]
            lengths = np.array([len(c) for c in chunks], np.int64)
            flat = [x for c in chunks for x in c]
            learn({*flat}.difference(numbers))
            ids = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
            p = marginals(table[ids], lengths, trans) * (ids > 0)[:, None]
            starts = np.minimum(np.r_[0, np.cumsum(lengths)[:-1]], len(p))
            sums = np.add.reduceat(np.vstack([p, np.zeros((1, k))]), starts, axis=0)
            words = np.add.reduceat(np.r_[(ids > 0).astype(float), 0.0], starts)
            sums[lengths == 0] = 0
            words[lengths == 0] = 0
            best = sums.argmax(1)
            return [(self.languages[b], float(min(1.0, s[b] / w))) if w else ("und", 0.0) for b, s, w in zip(best, sums, words)]

        return predict


def fit(rows: list[tuple[str, str]], steps: int = 60, span: int = 12, length: int = 48, seed: int = 5) -> Crf | None:
    """rows: (text, language). Adam on the log-likelihood of spliced word sequences."""
    count = Counter(lang for _, lang in rows)
    languages = sorted(sorted(count, key=lambda x: (-count[x], x))[:MAX_LANGUAGES])
    k = len(languages)
    pools = {lang: [w for t, x in rows if x == lang for c in t.lower().split() if (w := _letters(c))] for lang in languages}
    languages = [x for x in languages if pools[x]]
    k = len(languages)
    if not k:
        return None
    lexicon: dict[str, list[int]] = {}
    for i, lang in enumerate(languages):
        for w, _ in Counter(pools[lang]).most_common(LEXICON):
            lexicon.setdefault(w, []).append(i)
    lexicon = {w: tuple(v) for w, v in lexicon.items()}
    rng = np.random.default_rng(seed)
    words, labels = [], []
    total = 4_000
    for _ in range(total):
        seq, lab = [], []
        mixed = rng.random() < 0.5
        at = int(rng.integers(k))
        while len(seq) < length:
            pool = pools[languages[at]]
            n = int(rng.integers(2, 2 * span)) if mixed else length
            s = int(rng.integers(max(1, len(pool) - n)))
            part = pool[s : s + n]
            seq += part
            lab += [at] * len(part)
            at = int(rng.integers(k)) if mixed else at
        words.append(seq[:length])
        labels.append(lab[:length])
    known: dict[str, int] = {}
    x = np.array([[known.setdefault(w, len(known)) for w in seq] for seq in words])
    y = np.array(labels)
    named = [features_of(w, lexicon) for w in known]
    seen = Counter(f for fs in named for f in fs)
    index: dict[str, int] = {}
    feats = [[index.setdefault(f, len(index)) for f in fs if seen[f] > 1 or f[0] == "w"] for fs in named]
    flat, cuts = np.concatenate(feats), np.r_[0, np.cumsum([len(f) for f in feats])]
    owner = np.repeat(np.arange(len(feats)), np.diff(cuts))
    w, trans = np.zeros((len(index), k)), np.zeros((k, k))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    n = x.size
    for step in range(1, steps + 1):
        score = np.add.reduceat(w[flat], cuts[:-1], axis=0)
        tr, g_trans, by_word = np.exp(trans), np.zeros((k, k)), np.zeros((len(feats), k))
        slice_ = max(50, 16_000 // k)
        for begin in range(0, len(x), slice_):
            xs, ys = x[begin : begin + slice_], y[begin : begin + slice_]
            e = score[xs]
            e = np.exp(e - e.max(2, keepdims=True))
            alpha = np.empty_like(e)
            a = _norm(e[:, 0], 1)
            alpha[:, 0] = a
            for t in range(1, length):
                a = _norm((a @ tr) * e[:, t], 1)
                alpha[:, t] = a
            b = np.ones((len(xs), k))
            d = np.empty_like(e)
            for t in range(length - 1, -1, -1):
                d[:, t] = -_norm(alpha[:, t] * b, 1)
                if t:
                    back = e[:, t] * b
                    # the sum over sequences of their pair probabilities
                    z = ((alpha[:, t - 1] @ tr) * back).sum(1, keepdims=True)
                    g_trans -= tr * ((alpha[:, t - 1] / np.maximum(z, 1e-300)).T @ back)
                    np.add.at(g_trans, (ys[:, t - 1], ys[:, t]), 1)
                    b = _norm(back @ tr.T, 1)
            np.put_along_axis(d, ys[:, :, None], np.take_along_axis(d, ys[:, :, None], 2) + 1, 2)
            by_word += np.stack([np.bincount(xs.ravel(), d[:, :, i].ravel(), len(feats)) for i in range(k)], 1)
        g_w = np.stack([np.bincount(flat, by_word[owner, i], len(index)) for i in range(k)], 1)
        for param, g, i in ((w, g_w / n - 1e-6 * w, 0), (trans, g_trans / n, 2)):
            moments[i] = 0.9 * moments[i] + 0.1 * g
            moments[i + 1] = 0.99 * moments[i + 1] + 0.01 * g * g
            param += 0.1 * (moments[i] / (1 - 0.9**step)) / (np.sqrt(moments[i + 1] / (1 - 0.99**step)) + 1e-8)
    return Crf(languages, index, w, trans, lexicon)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame) -> Crf | None:
    known = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id"))).where(F.length("text") <= SAMPLE_CHARS)
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return None
    # first those whose hash is small enough, some more than are wanted, equal rows once; then of each language the smallest
    share = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, 1.5 * PER_LANGUAGE / max(1, r["n"])) * (1 << 30))) for r in counts], "lang string, below long"))
    some = known.join(share, "lang").where(F.pmod("h", F.lit(1 << 30)) <= F.col("below")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    rows = some.withColumn("nth", nth).where(F.col("nth") <= PER_LANGUAGE).collect()
    return fit([(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.lang, r.nth))])


def predict(docs: DataFrame, model: Crf | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row."""

    def run(batches):
        of = model.predictor() if model else lambda texts: [("und", 0.0)] * len(texts)
        for batch in batches:
            texts, done, a = batch.column(2), [], 0
            while a < len(texts):  # about a million code points at a time
                b, size = a, 0
                part = []
                while b < len(texts) and (not part or size < 1_000_000):
                    part.append(texts[b].as_py())
                    size += len(part[-1] or "")
                    b += 1
                done += of(part)
                a = b
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in done], pa.string()), pa.array([s for _, s in done], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs.select("doc_id", "text"), train(docs))
