"""Operator 4: substring dedup by sliding sentence spans.

From every sentence on, the shortest run of ``RUN`` sentences or more with ``LEAST_WORDS`` words or more is hashed, and the run that ends the text; hashes join globally; all
sentences that a repeated run covers go, except where the run is the first of its hash, by document id and text.

A passage that repeats inside longer sentences, or begins and ends within them, is no run of whole sentences. So a sentence of more than ``PIECE_WORDS`` words is also cut into
pieces, that end at words chosen by the hashes of the words around them alone, so that a passage is cut alike wherever it stands in a sentence; runs
of pieces and sentences are hashed beside those of whole sentences, and what they cover goes too.

A passage of 51 words that two documents share has a run in both. Piece ends are alike from ``NEAR`` + ``PIECE_WORDS`` words after its begin to as many
before its end (14 and 14), which leaves 23 words in pieces of ``PIECE_WORDS`` at most: three pieces or more, and over ``LEAST_WORDS`` words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from strataframe.llm.shared import slices, stored, table

RUN = 3
PIECE_WORDS = 10
LEAST_WORDS = 15
#: A piece ends at a word whose hash is the least of ``NEAR`` words on either side, where it is too long of fewer, at last at the least of each ``WINDOW`` words.
NEAR, WINDOW = 4, 7
_END = re.compile(r"[.!?]+\s+|\n\s*")
_WORD = re.compile(r"\S+\s*")
#: Null ids take numbers from here on, by their text: after every other document.
_NULL_IDS = 1 << 62
#: Distinct words whose hashes a worker keeps.
KEPT = 100_000
#: Odd bases of the two rolling hashes (any such numbers do).
_BASES = np.array([0x9E3779B97F4A7C17, 0xC2B2AE3D27D4EB4F], np.uint64)


class _Words(dict):
    """64-bit hashes of words, made when first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


_known = _Words()
_powers = [np.ones((2, 1), np.uint64), np.ones((2, 1), np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers 0 to n and more of the bases, and of their inverses."""
    if _powers[0].shape[1] <= n:
        many = 1 << max(10, n.bit_length())
        for i, base in enumerate((_BASES, np.array([pow(int(b), -1, 1 << 64) for b in _BASES], np.uint64))):
            table_ = np.repeat(base[:, None], many, axis=1)
            table_[:, 0] = 1
            _powers[i] = np.cumprod(table_, axis=1, dtype=np.uint64)
    return _powers


class Layout:
    """Where the words of a text end, and at which words its sentences and pieces do."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.ends = [m.end() for m in _WORD.finditer(self.text)]
        self.hashes = np.array(list(map(_known.__getitem__, self.text.lower().split())), np.uint64)
        self.sentences = self.units = np.zeros(0, np.int64)
        if n := len(self.ends):
            ends, stops = np.array(self.ends), np.array([m.end() for m in _END.finditer(self.text)], np.int64)
            place = np.minimum(np.searchsorted(ends, stops), n - 1)
            self.sentences = np.unique(np.concatenate([[0, n], place[ends[place] == stops] + 1]))  # white space before the first word ends nothing
            self.units = _pieces(self.hashes, self.sentences)

    def spans(self, run: int = RUN, least: int = LEAST_WORDS) -> np.ndarray:
        """(begin, end) in words of each run: of whole sentences, the one that ends the text, and those of pieces that are none of these."""
        words = self.sentences
        whole = reach(words, run, least)
        if len(whole) and whole[-1, 1] < words[-1]:  # the shortest that ends the text
            at = min(len(words) - 1 - run, int(np.searchsorted(words, words[-1] - least, "right")) - 1)
            whole = np.concatenate([whole, [[words[at], words[-1]]]])
        if len(self.units) == len(words):
            return whole
        parts = reach(self.units, run, least)
        same = np.zeros(words[-1], np.int64)
        same[whole[::-1, 0]] = whole[::-1, 1]  # the one that ends the text comes after that of its sentence, which counts here
        return np.concatenate([whole, parts[same[parts[:, 0]] != parts[:, 1]]])

    def runs(self, run: int = RUN, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """Spans, and for each a row of two 64-bit hashes of its words; case and white space don't count, nor where sentences end inside it."""
        spans = self.spans(run, least)
        if not len(spans):
            return spans, np.zeros((0, 2), np.uint64)
        h = self.hashes
        two = np.stack([h, (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)])
        up, down = _power(len(h))
        total = np.zeros((2, len(h) + 1), np.uint64)
        np.cumsum(two * up[:, : len(h)], axis=1, out=total[:, 1:])
        found = (total[:, spans[:, 1]] - total[:, spans[:, 0]]) * down[:, spans[:, 0]]
        found ^= (spans[:, 1] - spans[:, 0]).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        found ^= found >> np.uint64(32)
        return spans, (found * np.uint64(0xD6E8FEB86659FD93)).T

    def without(self, away: np.ndarray) -> tuple[str, int]:
        """The text without the words marked in ``away``, and how many sentences and pieces those are."""
        edges = np.flatnonzero(np.diff(np.concatenate([[True], away, [True]]).astype(np.int8)))
        begins = [0, *self.ends]
        kept = "".join(self.text[begins[a] : begins[b]] for a, b in zip(edges[::2], edges[1::2], strict=True))
        return kept.rstrip(), int(away[self.units[:-1]].sum())


def _pieces(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``bounds`` of sentences with those of the pieces of the long ones. Whether a piece ends at a word depends on the words near by, not on where the one before ended: its hash
    is below those of ``NEAR`` words before and not above those of as many after, and of fewer where that leaves a piece too long.
    """
    for near in range(NEAR, 0, -1):
        size = np.diff(bounds)
        if size.max() <= PIECE_WORDS:
            return bounds
        low, high, at = np.repeat(bounds[:-1], size), np.repeat(bounds[1:], size), np.arange(len(h))
        at = at[(high - low > PIECE_WORDS) & (at - low >= near) & (at < high - near - 1)]
        for d in range(1, near + 1):
            at = at[(h[at] < h[at - d]) & (h[at] <= h[at + d])]
        bounds = np.sort(np.concatenate([bounds, at + 1]))
    # words that repeat: the last of the least of each window
    more = [j + WINDOW - int(np.argmin(h[j : j + WINDOW][::-1])) for a, b in zip(bounds, bounds[1:]) if b - a > PIECE_WORDS for j in range(a, b - WINDOW + 1)]
    return np.unique(np.concatenate([bounds, np.array(more, np.int64)]))


def reach(bounds: np.ndarray | list[int], run: int = RUN, least: int = LEAST_WORDS) -> np.ndarray:
    """``bounds`` are the words at which sentences (or pieces) begin and the last one ends; for each that begins a run, (begin, end): the shortest of ``run`` of them and ``least`` words."""
    at = np.array(bounds, np.int64)
    if len(at) <= run:
        return np.zeros((0, 2), np.int64)
    end = np.maximum(np.arange(len(at)) + run, np.searchsorted(at, at + least))
    start = np.flatnonzero(end < len(at))
    return np.stack([at[start], at[end[start]]], axis=1)


def _keys(doc_id: str, text: str) -> dict[str, Column]:
    """What a row goes by: its order, the id or for a null one a number of the text's; and 64 bits of the text, so that rows that share an id with different texts keep their places apart."""
    t = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return {"k_": F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL_IDS) + F.shiftrightunsigned(t, 3)), "t_": t}


def span_table(docs: DataFrame, run: int = RUN, least: int = LEAST_WORDS) -> DataFrame:
    """A row a text that has runs: its key (``k_``, ``t_``) and, run by run, 64 bits of the hash and a number of 32 bits more and the run's place; the second number is -1 where the text had the run before."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            h1, h2, n = [], [], []
            for t in some.column(2).to_pylist():
                _, found = Layout(t).runs(run, least)
                n.append(len(found))
                h1.append(found[:, 0].view(np.int64))
                more = ((found[:, 1] >> np.uint64(33)) << np.uint64(32) | np.arange(len(found), dtype=np.uint64)).view(np.int64)  # below 2**63
                order = np.lexsort((np.arange(len(found)), found[:, 1], found[:, 0]))
                again = order[1:][(found[order[1:]] == found[order[:-1]]).all(axis=1)]
                more[again] = -1 - again
                h2.append(more)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x in (h1, h2)]
            out = pa.RecordBatch.from_arrays([some.column(0), some.column(1), *lists], ["k_", "t_", "h1_", "h2_"])
            yield out.filter(pa.array(np.array(n) > 0))

    keys = _keys("doc_id", "text")
    return docs.select(keys["k_"].alias("k_"), keys["t_"].alias("t_"), "text").mapInArrow(make, "k_ long, t_ long, h1_ array<long>, h2_ array<long>")


def repeated(spans: DataFrame, spark: SparkSession) -> DataFrame:
    """(``k_``, ``t_``, ``places_``): places of each text's runs that are not the first of their hash.

    A text's own repeats are known without a shuffle. Of the rest, only 64 bits of each hash are counted, which combines before the shuffle; runs
    whose 64 bits occur once, most of them, leave in the join with those counts, and 95 bits of the others name their first text. So a passage
    that a third of the documents share is one row in each aggregate, and its documents' rows are a join's, which Spark splits.
    """
    every = spans.select("k_", "t_", F.inline(F.arrays_zip("h1_", "h2_")))
    own = every.where("h2_ >= 0")
    many = own.groupBy("h1_").agg(F.count("*").alias("n_")).where("n_ > 1").select("h1_")
    some = own.join(many, "h1_").select("h1_", F.shiftright("h2_", 32).cast("int").alias("b_"), "k_", "t_", F.col("h2_").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("p_"))
    some = stored(some, spark)
    # rows that repeat an id and a text count as one here
    first = some.groupBy("h1_", "b_").agg(F.min(F.struct("k_", "t_")).alias("first_"), F.max(F.struct("k_", "t_")).alias("last_")).where("first_ <> last_").drop("last_")
    later = some.join(first, ["h1_", "b_"]).where("k_ <> first_.k_ or t_ <> first_.t_").select("k_", "t_", "p_")
    return later.unionByName(every.where("h2_ < 0").select("k_", "t_", (-1 - F.col("h2_")).cast("int").alias("p_"))).groupBy("k_", "t_").agg(F.collect_set("p_").alias("places_"))  # bounded by one text's runs


def dedup(docs: DataFrame, spark: SparkSession, run: int = RUN, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with ``text`` rewritten, ``n_chars`` recounted where it exists, and ``n_removed`` (sentences and pieces) added, in place of a column so named.

    A row stays a row, with an empty text if everything in it was repeated; null texts stay null. The first of a repeated run
    is the one of the smallest (doc_id, hash of text, place); null ids come last, by hash of text. Of rows that are equal in id and text, null ids included, one has what its text is due and the others lose
    every run. Texts of fewer than ``run`` sentences and pieces or ``least`` words have no runs and stay. Very long texts are
    taken whole. Other columns pass through, whatever their names.
    """
    docs = docs.drop("n_removed")
    spans = stored(span_table(docs, run, least), spark)
    names, own = docs.columns, [f"c{i}_" for i in range(len(docs.columns))]  # columns go by place, so their names can't clash or need quoting
    placed = docs.toDF(*own)
    keyed = placed.withColumns(_keys(own[names.index("doc_id")], own[names.index("text")]))
    marks = repeated(spans, spark)
    equal = stored(keyed.groupBy("k_", "t_").agg(F.count("*").alias("n_")).where("n_ > 1").drop("n_"), spark)
    if equal.isEmpty():
        joined = keyed.withColumn("all_", F.lit(False))
    else:  # stored with numbers, so that one of them is the same one whenever a task runs again
        same = stored(keyed.join(equal, ["k_", "t_"], "left_semi").withColumn("r_", F.monotonically_increasing_id()), spark)
        one = same.groupBy("k_", "t_").agg(F.min("r_").alias("one_"))
        others = same.join(one, ["k_", "t_"]).withColumn("all_", F.col("r_") != F.col("one_")).drop("r_", "one_")
        joined = keyed.join(equal, ["k_", "t_"], "left_anti").withColumn("all_", F.lit(False)).unionByName(others)
    joined = joined.join(marks, ["k_", "t_"], "left").select(*own, "places_", "all_")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None
        for b in slices(batches):
            texts, gone = [], []
            for text, starts, every in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist(), strict=True):
                n = 0
                if starts or every:  # most texts have nothing to remove and are not cut again
                    layout = Layout(text)
                    found = layout.spans(run, least)
                    away = np.zeros(len(layout.ends), bool)
                    for begin, end in found if every else found[np.array(starts)]:
                        away[begin:end] = True
                    if away.any():
                        text, n = layout.without(away)
                gone.append(n)
                texts.append(text)
            columns = [b.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            if count is not None:
                columns[count] = pa.array([n if t is None else len(t) for t, n in zip(texts, columns[count].to_pylist(), strict=True)], columns[count].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int32())], [*own, "n_removed"])

    return joined.mapInArrow(cut, StructType([*placed.schema.fields, StructField("n_removed", IntegerType())])).toDF(*names, "n_removed")


def op4_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), spark)
