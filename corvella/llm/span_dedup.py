"""Substring dedup by sliding sentence spans.

A sentence ends behind a word that ends with one of ``.!?`` or their full-width forms, before white space that holds a
newline, and with the text. Sentences of more than 2 * ``REACH`` words are cut further, before words whose digest is smaller
than those of the ``REACH`` words on either side; such cuts depend on the words around them alone, so a passage in
the midst of another sentence has the same ones in every text. From every piece on, a span is the shortest run of consecutive
pieces that holds ``LEAST_WORDS`` words; where a sentence ends and no such span does, the shortest run up to there is one
as well, else a passage could keep its last sentence. A run without white space of more than ``LETTERS`` code points counts as
several words, cut behind full-width stops and by content.

Spans are hashed (128 bits, A-Z lower-cased, white space as one space) and joined over all documents; the first place
of a span is the one with the smallest (doc_id, word number). Pieces covered by any other place go, each with the white
space behind it, and the rest is joined again.

Scale: spans are counted with partial sums per task, so a passage in a third of all documents sends one row a
task; only hashes that occur at more than one place are joined back; that join's hot hashes are split by
adaptive execution, as both sides are shuffled for it. Texts move once, to meet their list of places.

Cases: null text is empty and has no sentence; texts of fewer than ``LEAST_WORDS`` words have no span and stay whole; a
null doc_id keeps its text and counts for nothing; of rows that share a doc_id equal places count once, so
equal rows both stay; extra columns are kept only if named in ``keep``; empty tables give an empty table.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvella.llm.common import Memo, Scratch, documents

LEAST_WORDS = 30
REACH = 4
LETTERS = 100
#: Words that are worked on at a time.
SLICE = 1 << 19
_WORD = re.compile(rb"[^ \t-\r]+")
_STOPS = tuple(x.encode() for x in ".!?。！？")
#: Odd bases of the two halves of a span's hash and their inverses modulo 2^64, and factors of the mixing.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_C = np.array(_BASES, dtype=np.uint64)
_INVERSE = np.array([pow(b, -1, 1 << 64) for b in _BASES], dtype=np.uint64)
_MIX = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def _code(word: bytes) -> int:
    """60 bits of the word's MD5 digest, then 1 if a sentence ends with the word."""
    return int.from_bytes(hashlib.md5(word).digest()[:8], "big") & ~15 | word.endswith(_STOPS)


def _memo() -> Memo:
    return Memo(_code)


def _parts(word: bytes) -> list[bytes]:
    """A long run without white space in words of its own."""
    text = word.decode("utf-8", "surrogateescape")
    if len(text) <= LETTERS:
        return [word]
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    key = ((x * _C[0] + np.r_[x[1:], np.uint64(0)]) * _MIX[0]) >> np.uint64(8)
    cut = _low(key)
    cut[:REACH] = cut[len(x) - REACH :] = False
    cut[1:] |= np.isin(x[:-1], [ord(c) for c in "。！？"])
    at = [0, *np.flatnonzero(cut).tolist(), len(x)]
    return [text[a:b].encode("utf-8", "surrogateescape") for a, b in zip(at[:-1], at[1:]) if a < b]


def _low(key: np.ndarray) -> np.ndarray:
    """Whether a key is smaller than the REACH keys before it and not above those behind it."""
    ok = np.ones(len(key), bool)
    for j in range(1, REACH + 1):
        ok[j:] &= key[j:] < key[:-j]
        ok[:-j] &= key[:-j] <= key[j:]
    return ok


def words_of(text: bytes) -> tuple[list[bytes], list[int]]:
    """All words of a text, lower-cased, and the numbers of words up to the end of each line that has any."""
    words, ends = [], []
    for line in text.lower().split(b"\n"):
        if w := line.split():
            words += w if max(map(len, w)) <= LETTERS else [x for y in w for x in _parts(y)]
            ends.append(len(words))
    return words, ends


def spans(codes: np.ndarray, last: np.ndarray, cuts: np.ndarray):
    """Of texts laid end to end (``cuts``: where each begins, then the end; ``last``: a sentence ends with the word):
    (start, end, 2 x int64 hash) of all spans, and (start, end) of all sentences, as word numbers."""
    n = len(codes)
    first = np.flatnonzero(np.r_[True, last[:-1]])
    close = np.r_[first[1:], n]
    size = close - first
    within = np.arange(n) - np.repeat(first, size)
    inner = _low(codes >> np.uint64(4)) & (within >= REACH) & (np.repeat(size, size) - within > REACH)
    inner[first] = True
    begin = np.flatnonzero(inner)
    end = np.r_[begin[1:], n]
    k = np.minimum(np.searchsorted(end, begin + LEAST_WORDS), len(end) - 1)
    fits = (end[k] >= begin + LEAST_WORDS) & (end[k] <= cuts[np.searchsorted(cuts, begin, side="right")])
    start, stop = begin[fits], end[k[fits]]
    more = close[~np.isin(close, stop)]
    more = more[more - LEAST_WORDS >= cuts[np.searchsorted(cuts, more) - 1]]
    start, stop = np.r_[start, begin[np.searchsorted(begin, more - LEAST_WORDS, side="right") - 1]], np.r_[stop, more]
    # sums of hash times a power of the base before each word, so any span is a difference of two
    h = (codes | np.uint64(15))[:, None] * _MIX
    h ^= h >> np.uint64(29)
    power = np.cumprod(np.vstack([np.ones((1, 2), np.uint64), np.broadcast_to(_C, (n, 2))]), axis=0)
    back = np.cumprod(np.vstack([np.ones((1, 2), np.uint64), np.broadcast_to(_INVERSE, (n, 2))]), axis=0)
    sums = np.vstack([np.zeros((1, 2), np.uint64), np.cumsum(h * power[:n], axis=0)])
    acc = (sums[stop] - sums[start]) * back[start]
    return start, stop, ((acc ^ (acc >> np.uint64(31))) * _MIX[::-1]).view(np.int64), first, close


def _laid(texts: list[bytes], memo: Memo):
    """(codes, last, cuts) of texts laid end to end."""
    words, cuts, lines = [], [0], []
    for t in texts:
        w, ends = words_of(t)
        lines += [len(words) + e for e in ends]
        words += w
        cuts.append(len(words))
    codes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    last = (codes & np.uint64(1)).astype(bool)
    last[np.array(lines, np.int64) - 1] = True
    return codes, last, np.array(cuts)


def spans_of(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, pos) of every span."""

    def table(ids, texts, memo):
        codes, last, cuts = _laid(texts, memo)
        if not len(codes):
            return None
        start, _, h, _, _ = spans(codes, last, cuts)
        of = np.searchsorted(cuts, start, side="right") - 1
        return pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(np.array(ids, np.int64)[of]), pa.array((start - cuts[of]).astype(np.int32))], names=["h1", "h2", "doc_id", "pos"])

    def run(batches):
        memo = _memo()
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if i is None or not t:
                    continue
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size > 5 * SLICE:
                    if out := table(ids, texts, memo):
                        yield out
                    ids, texts, size = [], [], 0
            if out := table(ids, texts, memo):
                yield out

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "h1 long, h2 long, doc_id long, pos int")


def _places(text: bytes) -> np.ndarray:
    """Where each word of ``words_of`` begins, then the end of the text."""
    at = []
    for m in _WORD.finditer(text):
        at.append(m.start())
        if m.end() - m.start() > LETTERS:
            sizes = [len(p) for p in _parts(m.group().lower())]
            at += (m.start() + np.cumsum(sizes)[:-1]).tolist()
    return np.array([*at, len(text)])


def dedupe_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, text without repeated spans, n_sentences (before), n_dropped (sentences that lost words)."""
    scratch = Scratch(docs.sparkSession)
    places = F.struct("doc_id", "pos")
    counted = spans_of(docs).groupBy("h1", "h2").agg(F.min(places).alias("first"), F.max(places).alias("last")).where("first <> last")
    repeated = scratch.table("repeated", counted.select("h1", "h2", F.col("first.doc_id").alias("doc"), F.col("first.pos").alias("at")))
    lost = spans_of(docs).join(repeated, ["h1", "h2"]).where("doc_id <> doc or pos <> at")
    gone = lost.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "h1")).alias("gone"))
    out = T.StructType([*docs.select(*keep).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_dropped", T.LongType())])
    n = len(keep)

    def run(batches):
        memo = _memo()
        for batch in batches:
            texts, counts, dropped, lists = [], [], [], batch.column(n + 1)
            for i, t in enumerate(batch.column(n).cast(pa.binary()).to_pylist()):
                codes, last, cuts = _laid([t or b""], memo)
                counts.append(int(last.sum()))
                dropped.append(0)
                if lists[i].is_valid and len(codes):
                    start, stop, h, first, close = spans(codes, last, cuts)
                    held = dict(zip(zip(start.tolist(), h[:, 0].tolist()), stop.tolist()))
                    edge = np.zeros(len(codes) + 1, np.int64)
                    for pos, h1 in zip(lists[i].values.field(0).to_pylist(), lists[i].values.field(1).to_pylist()):
                        if (pos, h1) in held:  # else another row with this doc_id
                            edge[pos] += 1
                            edge[held[pos, h1]] -= 1
                    cut = np.cumsum(edge[:-1]) > 0
                    dropped[-1] = int(np.logical_or.reduceat(cut, first).sum())
                    at = _places(t)
                    t = t[: at[0]] + b"".join([t[at[k] : at[k + 1]] for k in np.flatnonzero(~cut).tolist()])
                texts.append(t or b"")
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=out.names)

    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"), F.col("doc_id").cast("long").alias("__id"))
    gone = gone.select(F.col("doc_id").alias("__doc"), "gone")
    return rows.join(gone, F.col("__id") == F.col("__doc"), "left").select(*keep, "__text", "gone").mapInArrow(run, out)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedupe_spans(documents(spark, sf_dir))
    return out.select("doc_id", "n_sentences", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


#: Runs without white space of over LETTERS code points are not cut here; the driver's tables hold none.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT doc_id, unnest(list_zip(range(1, len(l) + 1), l)) AS z
      FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS l FROM d)),
u AS (SELECT doc_id, z[1] AS pos, z[2] AS raw, translate(regexp_extract(z[2], '^[^\x20\x09-\x0D]+'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM x),
l AS (SELECT *, left(md5(w), 15) AS k, regexp_matches(w, '[.!?。！？]$') OR contains(raw, chr(10)) AS last FROM u),
s AS (SELECT *, coalesce(lag(last) OVER p, true) AS first FROM l WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
n AS (SELECT *, sum(first::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS sentence FROM s),
m AS (SELECT *, row_number() OVER q AS up, count(*) OVER (PARTITION BY doc_id, sentence) AS size,
        min(k) OVER (q ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS before, min(k) OVER (q ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS behind
      FROM n WINDOW q AS (PARTITION BY doc_id, sentence ORDER BY pos)),
b AS (SELECT *, first OR (up > 4 AND size - up >= 4 AND k < before AND k <= behind) AS begins FROM m),
g AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS piece FROM b),
p AS (SELECT doc_id, piece, min(pos) AS s, max(pos) + 1 AS e, max(up = size) AS closes FROM g GROUP BY ALL),
one AS (SELECT a.doc_id, a.s, z.e FROM p a ASOF JOIN p z ON a.doc_id = z.doc_id AND a.s + 30 <= z.e),
two AS (SELECT c.doc_id, a.s, c.e FROM (SELECT doc_id, e, e - 30 AS low FROM p WHERE closes AND (doc_id, e) NOT IN (SELECT (doc_id, e) FROM one)) c
        ASOF JOIN p a ON c.doc_id = a.doc_id AND c.low >= a.s),
ws AS (SELECT doc_id, list(w ORDER BY pos) AS ws FROM u GROUP BY doc_id),
h AS (SELECT doc_id, s, e, md5(array_to_string(ws[s:e - 1], ' ')) AS h FROM (FROM one UNION FROM two) JOIN ws USING (doc_id)),
lost AS (SELECT doc_id, s, e FROM h QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT g.doc_id, g.pos FROM g JOIN lost o ON o.doc_id = g.doc_id AND g.pos >= o.s AND g.pos < o.e),
k AS (SELECT g.doc_id, count(DISTINCT sentence) AS n, count(DISTINCT sentence) FILTER (WHERE o.pos IS NOT NULL) AS dropped,
        string_agg(raw, '' ORDER BY g.pos) FILTER (WHERE o.pos IS NULL) AS kept
      FROM g LEFT JOIN gone o ON o.doc_id = g.doc_id AND o.pos = g.pos GROUP BY g.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(dropped, 0) AS n_dropped,
       sha256(regexp_extract(t, '^[\x20\x09-\x0D]*') || coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
