"""BPE encoding and decoding with a contiguous rank array.

Each short word keeps its part boundaries and the ranks of adjacent pairs in two plain lists; the
smallest rank is searched again and again, its boundary deleted and the two neighbouring ranks
refreshed. Words are memoised per worker. Words above ``LONG_WORD`` parts use the same arrays with a
heap over them, since a repeated scan is quadratic; both give the leftmost smallest merge first.

The vocabulary file is a parameter (``path``). It is read from the worker's own installation, never
shipped or copied.

Texts are normalised and split by Python's tables of Unicode. A text with a code point that these don't know yet, but newer
ones may, is normalised and split by the library itself; its words are merged like all others.

Cases: null text counts as empty (0 tokens, empty text); strings of special tokens inside a text become
those special ids, as the vocabulary's own encoder does; extra columns are ignored; repeated rows give
repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.llm.common import Memo, documents

LONG_WORD = 64
_FAR = 1 << 60
#: White space where Python's and Unicode's classes differ: such texts take the pattern over the whole text.
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_WORKER: dict[str, "WordBpe"] = {}


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def merge_scan(parts: list[int], rank_of: dict) -> list[int]:
    """Merges by repeated scans for the leftmost smallest rank. rank_of: (left, right) -> (rank, merged)."""
    ranks = [rank_of.get(p, (_FAR, 0))[0] for p in zip(parts, parts[1:])]
    while ranks:
        low = min(ranks)
        if low == _FAR:
            break
        i = ranks.index(low)
        parts[i] = rank_of[parts[i], parts[i + 1]][1]
        del parts[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = rank_of.get((parts[i], parts[i + 1]), (_FAR, 0))[0]
        if i:
            ranks[i - 1] = rank_of.get((parts[i - 1], parts[i]), (_FAR, 0))[0]
    return parts


def merge_heap(parts: list[int], rank_of: dict) -> list[int]:
    """The same merges for long words, in n log n."""
    n = len(parts)
    after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
    heap = [(rank_of[p][0], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in rank_of]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j < 0 or (parts[i], parts[j]) != pair:
            continue
        parts[i] = rank_of[pair][1]
        alive[j] = False
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (p := (parts[a], parts[b])) in rank_of:
                heapq.heappush(heap, (rank_of[p][0], a, p))
    return [p for p, ok in zip(parts, alive) if ok]


class WordBpe:
    """Encoder and decoder for a tokenizer file: normaliser, split pattern, byte symbols, merges, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.prefix = model.get("continuing_subword_prefix") or ""
        if self.prefix or model.get("byte_fallback") or model.get("unk_token") is not None:
            raise ValueError("this vocabulary needs features that are not supported")
        self.vocab = vocab
        self.rank_of = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank_of[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.symbols = byte_symbols()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.spaces = regex.compile(r"\s+")
        self.path, self.library, self.assigned = path, None, set()
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.words = Memo(self._word)
        self.chunks = Memo(self._chunk)

    def forget(self) -> None:
        self.words.clear()
        self.chunks.clear()

    def _merged(self, symbols: list[str]) -> list[int]:
        symbols[-1] += self.suffix
        # symbols without an id are skipped, since the vocabulary has no unknown token
        parts = [i for s in symbols if (i := self.vocab.get(s)) is not None]
        return (merge_scan if len(parts) <= LONG_WORD else merge_heap)(parts, self.rank_of)

    def _word(self, word: str) -> list[int]:
        return self._merged([self.symbols[b] for b in word.encode("utf-8")])

    def _known(self, text: str) -> bool:
        """Whether Python's tables have all code points of the text."""
        new = set(text) - self.assigned
        if any(unicodedata.category(c) == "Cn" for c in new):
            return False
        self.assigned |= new
        return True

    def _by_library(self, text: str) -> tuple[bytes, str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        ids = [i for piece, _ in pieces for i in self._merged([*piece])]
        return np.array(ids, dtype="<u4").tobytes(), " ".join(map(self.text_of.__getitem__, ids))

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        """Of a run without white space: its ids as little-endian 32-bit integers, and their text."""
        ids = [i for w in self.pieces.findall(chunk) for i in self.words[w]]
        return np.array(ids, dtype="<u4").tobytes(), " ".join(map(self.text_of.__getitem__, ids))

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        if text.isascii():
            text = text.lower()
        elif not self._known(text):
            return [self._by_library(text)]
        else:
            text = self.spaces.sub(" ", unicodedata.normalize("NFC", text))
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        if _ODD_SPACE.search(text):
            return [self._chunk(text)]
        return [*map(self.chunks.__getitem__, text.split())]

    def _parts(self, text: str | None) -> list[tuple[bytes, str]]:
        if not text:
            return []
        if self.cut is None or not any(t in text for t in self.special):
            return self._plain(text)
        out = []
        for k, part in enumerate(self.cut.split(text)):
            out += [(self.special[part].to_bytes(4, "little"), part)] if k % 2 else self._plain(part) if part else []
        return out

    def encode_bytes(self, text: str | None) -> tuple[bytes, str]:
        """The ids as little-endian 32-bit integers, and what ``decode`` makes of them."""
        parts = self._parts(text)
        return b"".join([x[0] for x in parts]), " ".join([x[1] for x in parts if x[0]])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text)[0], dtype="<u4").tolist()

    def decode(self, ids) -> str:
        """Token strings joined by one space, as the library does for a file without a decoder."""
        return " ".join(map(self.text_of.__getitem__, ids))


def worker_bpe(path: str) -> WordBpe:
    if path not in _WORKER:
        _WORKER[path] = WordBpe(path)
    return _WORKER[path]


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Adds to the ``keep`` columns: n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` ids and decoded.

    One pass without a shuffle; memory is bounded by a batch of rows and the memo tables.
    """
    schema = docs.select(*keep).schema
    from pyspark.sql import types as T

    out = T.StructType([*schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if with_ids:
        out = T.StructType([*out.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches):
        bpe = worker_bpe(path)
        try:
            for batch in batches:
                n, ids_hex, text_hex, all_ids, all_text = [], [], [], [], []
                column = batch.column(len(keep))
                for i in range(len(column)):
                    ids, decoded = bpe.encode_bytes(column[i].as_py())
                    n.append(len(ids) // 4)
                    ids_hex.append(hashlib.sha256(ids).hexdigest())
                    text_hex.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                    if with_ids:
                        all_ids.append(np.frombuffer(ids, dtype="<u4").tolist())
                        all_text.append(decoded)
                more = [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text, pa.string())] if with_ids else []
                columns = [*batch.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string()), *more]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)
        finally:
            bpe.forget()  # workers live on; what one task memoised must not add to the next stage's memory


    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, out)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
