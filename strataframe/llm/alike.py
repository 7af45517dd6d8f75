"""Links of texts by the Jaccard similarity of their word shingles: candidates by MinHash bands, then by prefixes of rare shingles, each one checked exactly.

Two texts of similarity s meet in a bucket of one of ``BANDS`` bands with s ** ``ROWS`` each, so in one at least with 0.9996 at 0.8. In each bucket every text is held against
the bucket's least, which costs rows in proportion to its size whatever that is, and in most buckets that makes one component. What is left open are
texts that share a bucket with a text that they are not linked to; among all of those the links are found exactly, without buckets: shingles are ordered from rare to
common, and two texts as alike as asked share one among the first few of each (prefix filter). Texts of one
template, which meet in every bucket and are not alike enough, have nothing but their own shingles there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.components import connected_components
from strataframe.llm.shared import slices, stored

BANDS, ROWS = 20, 5
#: Words of a text's map of shingles, a power of 2.
MAPS = 8
_R = np.random.default_rng(29)
_A = _R.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _R.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of each ``n`` words in a row; of fewer words, of all of them. No words: none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = zip(*[words[i:] for i in range(n)], strict=False) if len(words) > n else [words]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), 7) for g in grams), np.uint64))


def _keys(sigs: np.ndarray) -> np.ndarray:
    """A key for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for s in range(0, len(sigs), 4096):  # bounds the matrix of a very long text
        x = sigs[s : s + 4096, None] * _A + _B
        x ^= x >> np.uint64(31)
        least = np.minimum(least, (x * np.uint64(0x9E3779B97F4A7C15)).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def links(texts: DataFrame, spark: SparkSession, least: float = 0.8, n: int = 5) -> DataFrame:
    """``texts(id, text)`` (longs, each once) to ``(a, b)``, a < b: texts of similarity ``least`` or more.

    Not every such pair: enough of them that texts which share a bucket and are linked are in one component. Texts without words have no links. Ids that
    are null are left out; no texts give no links.
    """
    texts = texts.select("id", "text").where("id is not null")

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, keys = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(s := shingles(t, n)):
                    ids.append(i)
                    keys.append(_keys(s))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), BANDS)), pa.array(flat)], ["id", "key"])

    each = stored(texts.mapInArrow(banded, "id long, key long"), spark)
    heads = each.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("many")).where("many > 1")
    each = stored(each.join(heads, "key"), spark)  # buckets of two and more
    first = verified(each.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")), texts, spark, least, n)
    part = connected_components(first.select(F.col("a").alias("u"), F.col("b").alias("v")), spark).withColumnRenamed("component_id", "p")
    rest = each.where("many > 2").join(part, "id", "left").select("id", "key", F.coalesce("p", "id").alias("p"))
    rest = stored(rest, spark)
    split = rest.groupBy("key").agg(F.min("p").alias("low"), F.max("p").alias("high")).where("low < high").select("key")
    open_ = stored(rest.join(split, "key").groupBy("id").agg(F.min("p").alias("p")), spark)
    second = verified(rare_candidates(open_, texts, spark, least, n), texts, spark, least, n)
    return first.unionByName(second)


def rare_candidates(open_: DataFrame, texts: DataFrame, spark: SparkSession, least: float, n: int) -> DataFrame:
    """``open_(id, p)`` to ``(a, b)``: all pairs of different ``p`` whose texts can have similarity ``least``, and some that don't.

    With shingles in one order for all texts, those in which two texts first agree have places i and j, and no more agree than follow: of sizes x <= y, ``least`` needs
    ceil(least / (1 + least) * (x + y)) of them. So the smaller text is found by its first x - ceil(2 * least / (1 + least) * x) + 1 shingles, among the first
    y - ceil(least * y) + 1 of the larger one. Most shingles of open texts occur once and come first, so they are counted and not moved again.

    Of texts that share such shingles, those leave whose difference is too large for sure: the shingles that occur once in either, and the bits in which two maps of ``64 * MAPS`` bits of their other
    shingles differ, each of which is a shingle of one text alone at least. So near misses by the thousand, which one template's texts are, make no rows.
    """

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(t, n).view(np.int64) for t in b.column(2).to_pylist()]
            size = np.array([len(s) for s in sets], np.int64)
            ids, parts = (np.repeat(b.column(k).to_numpy(), size) for k in (0, 1))
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(ids), pa.array(parts), pa.array(np.repeat(size, size).astype(np.int32))], ["s", "id", "p", "n"])

    tokens = stored(open_.join(texts, "id").select("id", "p", "text").mapInArrow(exploded, "s long, id long, p long, n int"), spark)
    shared = tokens.groupBy("s").agg(F.count("*").alias("f"), F.min("p").alias("low"), F.max("p").alias("high")).where("f > 1")
    shared = stored(tokens.join(shared, "s").select("s", "id", "p", "n", "f", (F.col("low") < F.col("high")).alias("mixed")), spark)
    order = F.array_sort(F.collect_list(F.struct("f", "s", "mixed")))  # one text's shingles
    slot, bit = F.shiftrightunsigned("s", 6).bitwiseAND(F.lit(MAPS - 1)), F.expr("shiftleft(1L, cast(s & 63 as int))")
    maps = [F.coalesce(F.bit_or(F.when(slot == i, bit)), F.lit(0).cast("long")).alias(f"m{i}") for i in range(MAPS)]
    names = ["own", *[f"m{i}" for i in range(MAPS)]]
    placed = shared.groupBy("id", "p", "n").agg(order.alias("o"), *maps).withColumn("own", F.col("n") - F.size("o")).select("id", "p", "n", *names, F.posexplode("o").alias("k", "e"))
    at = F.col("own") + F.col("k")
    share = least / (1 + least)
    placed = placed.select("id", "p", "n", *names, F.col("e.s").alias("s"), at.alias("at"), "e.mixed").where(f"mixed and at <= n - ceil({least} * n - 1e-9)").drop("mixed")
    placed = placed.withColumn("few", F.expr(f"at <= n - ceil({2 * share} * n - 1e-9)"))
    # pairs within a component are not asked for: each shingle's largest component meets the others, not itself
    most = placed.groupBy("s", "p").agg(F.count("*").alias("c")).groupBy("s").agg(F.max_by("p", F.struct("c", "p")).alias("most"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    placed = stored(placed.join(most, "s"), spark)
    x = placed.where("p <> most").select("s", F.col("id").alias("x"), F.col("p").alias("px"), F.col("n").alias("nx"), F.col("at").alias("i"), F.col("few").alias("fx"), *[F.col(c).alias(f"x_{c}") for c in names])
    y = placed.select("s", F.col("id").alias("y"), F.col("p").alias("py"), F.col("n").alias("ny"), F.col("at").alias("j"), F.col("few").alias("fy"), *[F.col(c).alias(f"y_{c}") for c in names])
    can = f"px <> py and ((nx <= ny and fx) or (ny <= nx and fy)) and least(nx, ny) >= {least} * greatest(nx, ny) and least(nx - i, ny - j) >= ceil({share} * (nx + ny) - 1e-9)"
    apart = " + ".join(f"bit_count(x_m{i} ^ y_m{i})" for i in range(MAPS))
    can += f" and x_own + y_own + {apart} <= nx + ny - 2 * ceil({share} * (nx + ny) - 1e-9)"
    return x.join(y, "s").where(can).select(F.col("x").alias("a"), F.col("y").alias("b"))


def verified(pairs: DataFrame, texts: DataFrame, spark: SparkSession, least: float = 0.8, n: int = 5) -> DataFrame:
    """``pairs(a, b)`` in any order, and repeated, to those ``(a, b)``, a < b, whose texts have similarity ``least`` or more.

    Texts move, which are smaller than their sets of shingles. A text that many pairs name is cut into shingles once a task, as pairs come sorted by it.
    """

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, y = None, None
        for b in slices(batches):
            good = []
            for at, (name, text) in enumerate(zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if name != known:
                    known, y = name, shingles(text, n)
                x = shingles(b.column(2)[at].as_py(), n)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= least * max(len(x), len(y)) else 0
                good.append(both > 0 and both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    # the lesser id, which heads buckets, is joined last: its pairs are together
    pairs = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), spark)
    # stored, so that its size is known: where it is small Spark broadcasts it, and texts stay where they are
    ends = stored(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), spark)
    of = stored(texts.join(ends, "id", "left_semi"), spark)
    full = pairs.join(of.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(of.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    found = full.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long")
    return stored(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), spark)
