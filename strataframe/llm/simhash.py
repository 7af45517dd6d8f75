"""Operator 7: SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is two 32-bit segments. Fingerprints within 3 bits agree, in one segment at least, to
floor(3 / 2) = 1 bit, so each one looks its segments' Hamming balls of radius 1 (33 keys each) up in the table of
segments and the complete distance decides. With 32-bit keys a look-up meets N / 2^32 strangers, so candidates
stay few at any size the cluster can hold. Equal fingerprints are one row before the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.components import connected_components
from strataframe.llm.shared import stored, table


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text as an unsigned 64-bit number: a bit is set if it is in over half of the shingles' hashes.

    No words: 0. Fewer words than a shingle: the hash of the whole sequence.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    grams = zip(*[words[i:] for i in range(shingle)], strict=False)
    n, ones, chunk = len(words) - shingle + 1, np.zeros(64, np.int64), []
    for gram in grams:
        chunk.append(xxhash.xxh64_digest(b" ".join(gram), 42))
        if len(chunk) == 16384:  # bounds the bit matrix of a very long text
            ones += _bits(chunk)
            chunk = []
    if chunk:
        ones += _bits(chunk)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _bits(digests: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``: ``fp`` is the fingerprint as a signed long. Null and empty texts: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """``prints(fp)``, each once, to ``(a, b)``, a < b: all pairs that differ in 1 to ``distance`` bits (3 at most)."""
    if not 1 <= distance <= 3:
        raise ValueError("two segments with balls of radius 1 cover distances 1 to 3")
    mask = F.lit(0xFFFFFFFF)
    halves = F.array(F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", 32).alias("key")), F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(mask).alias("key")))
    keys = prints.select("fp", F.inline(halves))
    ball = F.expr("concat(array(key), transform(sequence(0, 31), i -> key ^ shiftleft(1L, i)))")
    probes = keys.select(F.col("fp").alias("a"), "seg", F.explode(ball).alias("key"))
    found = probes.join(keys.withColumnRenamed("fp", "b"), ["seg", "key"]).where("a < b")
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, spark: SparkSession, distance: int = 3, shingle: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fingerprint, n_links, component_id)``, a row a document.

    Fingerprints link at ``distance`` differing bits or fewer, the same ones always; ``n_links`` counts other fingerprints that
    are linked. ``component_id`` is the smallest id reachable, the document's own included. Texts without words share
    fingerprint 0. Rows with a null id are members of their group but never give it its name; a group of nothing
    but null ids has a null one. No documents: no rows. Other columns are ignored.
    """
    prints = stored(fingerprints(docs, shingle), spark)
    groups = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), spark)
    near = stored(links(groups.select("fp"), distance), spark)
    ends = near.select(F.col("a").alias("fp")).unionByName(near.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    parts = connected_components(near.select(F.col("a").alias("u"), F.col("b").alias("v")), spark).select(F.col("id").alias("fp"), F.col("component_id").alias("part"))
    named = groups.join(ends, "fp", "left").join(parts, "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    least = named.groupBy("part").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "part").select("fp", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_links", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), spark)
