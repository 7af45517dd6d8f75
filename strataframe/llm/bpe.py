"""Operator 2: byte-level BPE encoding and decoding over length-bucketed padded numpy matrices.

Each batch's distinct words (matches of the split pattern) become rows of byte ids, grouped by length and padded. Every round,
all rows of a matrix look their adjacent pairs up in a hashed table and merge their leftmost pair of least rank; the row then
closes up, and finished rows leave. Words over ``LONGEST`` bytes, for which quadratic rounds are too slow (README has figures), take the
same merges in the same order from a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from strataframe.llm.shared import table

#: Words of up to this many bytes go through the matrices.
LONGEST = 128
#: Words whose encodings a worker keeps; the memory of a task stays bounded however many distinct words there are.
KEPT = 400_000
_NONE = np.int64(1 << 40)


class Merges:
    """A rank file's tokens, and a hash table from adjacent pairs to the rank of what they join to."""

    def __init__(self, rank_file: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.token = {r: t for t, r in self.rank.items()}
        self.width = max(self.rank.values()) + 1
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                a, b = self.rank.get(t[:i]), self.rank.get(t[i:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = r
        self.pairs = pairs
        self.bits = max(10, (2 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int64)
        keys, ranks = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        at = self._slot(keys)
        self.probes = 0
        while len(keys):  # linear probing, all keys at once: one key wins each free slot
            free = self.keys[at] == -1
            winner = np.zeros(len(keys), bool)
            winner[np.flatnonzero(free)[np.unique(at[free], return_index=True)[1]]] = True
            self.keys[at[winner]], self.ranks[at[winner]] = keys[winner], ranks[winner]
            keys, ranks, at = keys[~winner], ranks[~winner], (at[~winner] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair key, or ``_NONE``."""
        flat = keys.ravel()
        at, out = self._slot(flat), np.full(len(flat), _NONE, np.int64)
        open_ = np.arange(len(flat))
        for _ in range(self.probes + 1):
            there = self.keys[at]
            hit = there == flat[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            go = ~hit & (there != -1)
            if not go.any():
                break
            open_, at = open_[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out.reshape(keys.shape)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        out: list[list[int]] = [[]] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if (whole := self.rank.get(w)) is not None:
                out[i] = [whole]
            elif len(w) > LONGEST:
                out[i] = self._encode_long(w)
            elif w:
                buckets.setdefault(max(4, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            step = max(1, (1 << 20) // width)
            for k in range(0, len(rows), step):
                self._encode_matrix(words, rows[k : k + step], width, out)
        return out

    def _encode_matrix(self, words: list[bytes], rows: list[int], width: int, out: list) -> None:
        ids = np.full((len(rows), width + 1), -1, np.int64)
        size = np.array([len(words[i]) for i in rows])
        filled = np.arange(width)[None, :] < size[:, None]
        ids[:, :width][filled] = self.byte[np.frombuffer(b"".join(words[i] for i in rows), np.uint8)]
        index, columns = np.array(rows), np.arange(width + 1)
        while len(ids):
            left, right = ids[:, :-1], ids[:, 1:]
            ranks = np.full(left.shape, _NONE, np.int64)
            real = right >= 0
            ranks[real] = self.lookup(left[real] * self.width + right[real])
            at = ranks.argmin(axis=1)  # the leftmost of the least
            best = ranks[np.arange(len(ids)), at]
            done = best == _NONE
            if done.any():
                for i, row in zip(index[done].tolist(), ids[done].tolist(), strict=True):
                    out[i] = row[: row.index(-1)]
                ids, index, at, best = ids[~done], index[~done], at[~done], best[~done]
                if not len(ids):
                    break
            source = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), width)
            ids = np.take_along_axis(ids, source, axis=1)  # close up over the pair's right half
            ids[np.arange(len(ids)), at] = best
            keep = int((ids >= 0).sum(axis=1).max()) + 1
            if keep < len(columns):
                ids, columns, width = ids[:, :keep], columns[:keep], keep - 1

    def _encode_long(self, word: bytes) -> list[int]:
        """The same merges for one very long word: a heap of (rank, place) over a linked list."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, width, none = self.pairs, self.width, None
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] * width + ids[i + 1], none)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get(ids[i] * width + ids[j]) != r:
                continue  # merged away or changed since
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := pairs.get(r * width + ids[k])) is not None:
                    heapq.heappush(heap, (x, i))
            if (p := before[i]) >= 0 and (x := pairs.get(ids[p] * width + r)) is not None:
                heapq.heappush(heap, (x, p))
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_built: dict[str, Merges] = {}


def merges(rank_file: bytes) -> Merges:
    """Built once in each Python worker."""
    name = hashlib.sha256(rank_file).hexdigest()
    if name not in _built:
        _built.clear()
        _built[name] = Merges(rank_file)
    return _built[name]


class Encoder:
    """Whole texts to token ids, remembering words."""

    def __init__(self, m: Merges, pattern: str):
        self.m, self.split, self.known = m, regex.compile(pattern), {}

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        known, split = self.known, self.split
        for k in range(0, len(texts), 256):
            words = [split.findall(t) for t in texts[k : k + 256]]
            new = list({w for ws in words for w in ws if w not in known})
            if len(known) + len(new) > KEPT:
                known.clear()
                new = list({w for ws in words for w in ws})
            known.update(zip(new, self.m.encode_words([w.encode("utf-8", "replace") for w in new]), strict=True))
            for ws in words:
                yield [i for w in ws for i in known[w]]


def rank_bytes(path: str | None = None) -> tuple[bytes, str]:
    """A rank file's bytes, read on the driver and broadcast (under 1 MB), and the split pattern."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encode(docs: DataFrame, spark: SparkSession, path: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, ids array<int>)``. Null texts: empty. Other columns are ignored."""
    raw, pattern = rank_bytes(path)
    shared = spark.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(merges(shared.value), pattern)
        for b in batches:
            for some in _slices(b):
                ids = list(coder.encode([t or "" for t in some.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, spark: SparkSession, path: str | None = None) -> DataFrame:
    """``encoded(doc_id, ids)`` to ``(doc_id, data binary)``. Null ids: empty. Ids that the vocabulary lacks raise."""
    raw, _ = rank_bytes(path)
    shared = spark.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(shared.value)
        for b in batches:
            for some in _slices(b):
                data = [m.decode(x or []) for x in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, spark: SparkSession, path: str | None = None, ids: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` and, where asked for, ``ids array<int>``: encode and decode in one pass.

    The decoded bytes come from the ids alone. Null and empty texts have no tokens and hash as empty strings; very long texts and words are encoded
    whole. Repeated rows are rows of their own. Other columns are ignored. No documents: no rows.
    """
    raw, pattern = rank_bytes(path)
    shared = spark.sparkContext.broadcast(raw)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(shared.value)
        coder = Encoder(m, pattern)
        decimal = [str(i) for i in range(m.width)]
        for b in batches:
            for some in _slices(b):
                counts, coded, decoded, flat = [], [], [], []
                for found in coder.encode([t or "" for t in some.column(1).to_pylist()]):
                    counts.append(len(found))
                    coded.append(hashlib.sha256(",".join(map(decimal.__getitem__, found)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(m.decode(found)).hexdigest())
                    if ids:
                        flat.append(np.array(found, np.int32))
                columns = [some.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(flat, pa.list_(pa.int32()))] if ids else [])], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else ""))


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that Python objects of a batch of long texts don't all live at once."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), spark)
