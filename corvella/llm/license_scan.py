"""License scans: winnowed fingerprints pick candidates, banded sequence alignment reports coverage and spans.

Templates and texts are word sequences (lower case, letters and digits). Every run of ``GRAM`` words has a hash, and
each window of ``WINDOW`` successive hashes selects its smallest; so any common run of GRAM + WINDOW - 1 words
shares a selected fingerprint. The inverted index maps fingerprints to places in templates. Hits of one template that
follow each other make a candidate as long as their diagonals are less than half the template apart, so words inserted or
left out within don't part it; it is aligned in the band of these diagonals and ``BAND`` more on either side, in time
and memory of the template's length times the band's width. Coverage is the share of the template's words that match; at
least ``COVERAGE`` is reported.

The templates are a parameter and a fixed small set, so they go to every worker; texts are read once without
a shuffle. Of templates that match overlapping places the one with most matched words is reported, of equals the one with
the higher coverage, then the earlier, then the first by name.

Cases: null or empty texts give no row; a null doc_id is kept as such; templates without words are ignored;
those shorter than GRAM words are compared by all their words in a row; repeated rows give repeated rows; empty
tables give an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.llm.common import documents
from corvella.llm.license_templates import TEMPLATES
from corvella.llm.wordseq import Numberer, align, grams, words_of

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8
_NONE = np.iinfo(np.int64).max


def _hash(g: np.ndarray) -> np.ndarray:
    """Spreads n-gram numbers; n-grams with unknown words get the largest value and are never selected."""
    x = (g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(2)
    return np.where(g < 0, _NONE, (x ^ (x >> np.uint64(29))).astype(np.int64))


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest hash of each window, the rightmost of equals."""
    if not len(h):
        return np.zeros(0, np.int64)
    if len(h) <= window:
        at = np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
    else:
        view = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
        at = np.unique(np.arange(len(view)) + window - 1 - view.argmin(1))
    return at[h[at] != _NONE]


def _candidates(hits: list[tuple[int, int]], far: int, size: int) -> list[tuple[int, int]]:
    """The lowest and highest diagonal of each run of hits (diagonal, place in the text), in order of the diagonals.

    Runs are kept open until the text is a template's length behind their last hit, since places of different runs may
    lie among each other.
    """
    open_, out = [], []
    for d, j in hits:
        live = [r for r in open_ if j - r[2] <= size + far]
        out += [r for r in open_ if j - r[2] > size + far]
        near = [r for r in live if max(r[1], d) - min(r[0], d) <= far]
        if near:
            r = min(near, key=lambda r: abs(r[3] - d))
            r[0], r[1], r[2], r[3] = min(r[0], d), max(r[1], d), j, d
        else:
            live.append([d, d, j, d])
        open_ = live
    return sorted((r[0], r[1]) for r in out + open_)


class Index:
    def __init__(self, templates: dict[str, str]):
        seqs = {k: w for k, t in sorted(templates.items()) if (w := words_of(t))}
        self.names = list(seqs)
        self.vocab: dict[str, int] = {}
        for ws in seqs.values():
            for w in ws:
                self.vocab.setdefault(w, len(self.vocab) + 1)
        self.base = len(self.vocab) + 1
        self.ids = [np.array([self.vocab[w] for w in seqs[k]]) for k in self.names]
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, ids in enumerate(self.ids):
            n = min(GRAM, len(ids))
            h = _hash(grams(ids, n, self.base))
            for at in winnow(h):
                self.places.setdefault(n, {}).setdefault(int(h[at]), []).append((t, int(at)))
        self.keys = {n: np.array(sorted(p)) for n, p in self.places.items()}

    def find(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, matched words, start word, end word) of what the text covers well enough."""
        hits: dict[int, list[tuple[int, int]]] = {}
        for n, keys in self.keys.items():
            h = _hash(grams(ids, n, self.base))
            if not len(h) or h.min() == _NONE:
                continue
            at = winnow(h) if n == GRAM else np.flatnonzero(h != _NONE)
            near = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            for j in at[keys[near] == h[at]]:
                for t, p in self.places[n][int(h[j])]:
                    hits.setdefault(t, []).append((int(j) - p, int(j)))
        found = []
        for t, places in hits.items():
            template, done = self.ids[t], 0
            enough, far = COVERAGE * len(template), len(template) // 2
            for low, high in _candidates(sorted(places, key=lambda x: (x[1], x[0])), far, len(template)):
                low, high = low - BAND, high + BAND
                start, end = max(done, low), high + len(template)  # behind what was found before
                if np.isin(template, ids[start:end]).sum() < enough:
                    continue
                _, n, _, _, b, e = align(template, ids[start:end], (low - start, high - start))
                if n >= enough:
                    found.append((t, n, start + b, start + e))
                    done = start + e
        # the longest first; a template within a place that a longer one covers says nothing new
        out = []
        for x in sorted(found, key=lambda x: (-x[1], -x[1] / len(self.ids[x[0]]), x[2], x[0])):
            if not any(x[2] < e and b < x[3] for _, _, b, e in out):
                out.append(x)
        return sorted(out, key=lambda x: x[2])


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, coverage, matched, start_word, end_word) of each place."""
    index = Index(TEMPLATES if templates is None else templates)

    def run(batches):
        number = Numberer(index.vocab)
        for batch in batches:
            rows = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(doc, index.names[k], n / len(index.ids[k]), n, b, e) for k, n, b, e in index.find(number(t))]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "license", "coverage", "matched", "start_word", "end_word"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, license string, coverage double, matched long, start_word long, end_word long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
