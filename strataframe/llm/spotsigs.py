"""Operator 3: document fingerprints by SpotSigs. DataFrame functions only.

Where a common word stands (an anchor), the content words that follow it form a chain; the hash of anchor and chain is a
signature, and a text's fingerprint is the set of its signatures. Likeness is the Jaccard similarity of two sets; sets whose
sizes alone bound it below what is asked are never intersected, and a search looks only at neighbouring partitions by set size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.llm.shared import COMMON, stored, table

#: Anchors.
ANCHORS = COMMON
#: Content words in a chain, and the words after an anchor in which they are looked for.
CHAIN, REACH = 2, 8
#: Besides common words, one content word in so many is an anchor, by its hash alone, so that texts in other languages have signatures too.
ONE_IN = 8


def word_codes(text: Column) -> Column:
    """A number for each word, lower-cased and without sentence marks: its hash, the lowest bit set for an anchor."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s.,;:!?]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.when(w.isin(ANCHORS), F.xxhash64(w).bitwiseOR(F.lit(1))).otherwise(F.xxhash64(w).bitwiseAND(F.lit(-2))))


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: sorted distinct signatures (ints) of column ``text``. Null and blank texts have none, any other one at least.

    The text's start is an anchor. A signature depends on the anchor and the words after it alone, whatever else the text holds.
    """
    # transform(array(x), name -> ...)[0] names a value: the codes are computed once and stay an array of objects, of which
    # slice() takes a part without copying the whole
    let = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    chain = lambda at: f"slice(filter(slice(c, {at}, {REACH}), y -> y & 1 = 0), 1, {CHAIN})"
    spots = f"transform(c, (x, i) -> if(x & 1 = 1 or shiftright(x, 1) & {ONE_IN - 1} = 0, hash(x, {chain('i + 2')}), null))"
    found = f"array_sort(array_distinct(array_compact(concat(array(hash(1L, {chain('1')})), {spots}))))"
    codes = f"{out}_codes_"
    df = df.withColumn(codes, word_codes(F.col(text)))
    return df.withColumn(out, F.expr(let(codes, "c", f"if(size(c) = 0, cast(array() as array<int>), {found})"))).drop(codes)


def printed(signatures: Column) -> Column:
    """A set as text: eight hex digits a signature, in order."""
    return F.array_join(F.transform(signatures, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), " ")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without intersecting them where sizes bound it below ``least``. Two empty sets: 1."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(large == 0, 1.0).when((small == 0) | (small < F.lit(float(least)) * large), 0.0).when(a == b, 1.0).otherwise(both / (F.size(a) + F.size(b) - both).cast("double"))


def set_partition(size: Column, least: float) -> Column:
    """Partition of a set by its size: sets of likeness ``least`` or more are in the same or in neighbouring ones."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(-math.log(least))).cast("int")


def near_pairs(sets: DataFrame, spark: SparkSession, least: float = 0.8) -> DataFrame:
    """``sets(doc_id, sigs)`` to ``(a, b, likeness)``, a < b: one row for each pair of distinct sets of likeness >= ``least``.

    Equal sets are one row named by their smallest id. Each set is posted under its rarest signatures, enough of them
    that two sets as alike as asked share one (prefix filter), in its own size partition and, to meet the next, in that; only those
    candidates that sizes allow are intersected. Null and empty sets link with nothing.
    """
    one = stored(sets.where("size(sigs) > 0").groupBy("sigs").agg(F.min("doc_id").alias("doc_id")), spark)
    one = one.withColumn("part", set_partition(F.size("sigs"), least))
    each = one.select("doc_id", F.explode("sigs").alias("s"))
    seen = each.groupBy("s").agg(F.count("*").alias("n"))
    order = each.join(seen, "s").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("o"))
    prefix = F.expr(f"slice(o, 1, size(o) - cast(ceil({least} * size(o) - 1e-9) as int) + 1).s")
    posted = stored(one.join(order.select("doc_id", prefix.alias("p")), "doc_id").select("doc_id", "part", F.size("sigs").alias("n"), F.explode("p").alias("s")), spark)
    left = posted.select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), "s", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = posted.select(F.col("doc_id").alias("y"), F.col("n").alias("ny"), "s", "part")
    can = F.expr(f"nx <= ny and nx >= {least} * ny and (nx < ny or x < y)")
    found = left.join(right, ["s", "part"]).where(can).select("x", "y").distinct()
    sets_x, sets_y = one.select(F.col("doc_id").alias("x"), F.col("sigs").alias("sx")), one.select(F.col("doc_id").alias("y"), F.col("sigs").alias("sy"))
    pairs = found.join(sets_x, "x").join(sets_y, "y").withColumn("likeness", likeness(F.col("sx"), F.col("sy"), least)).where(F.col("likeness") >= least)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness")


def id_range(docs: DataFrame, rows: int = 500, segments: int = 256) -> tuple[Column, Column]:
    """(segment, range): numbers that rise with (``doc_id``, ``h_``) and cut the rows into ranges of about ``rows`` each; ``h_`` is a hash of the text.

    Segments come from quantiles of all ids, so ids may lie in any way, and each is cut evenly. An id that is several quantiles holds many rows; those
    are cut by ``h_``, as null ids are, which lie below all others.
    """
    n, nulls, bounds = docs.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull()), F.percentile_approx("doc_id", [i / segments for i in range(segments)], 10_000)).first()
    share = lambda parts: F.least(parts - 1, F.floor((F.col("h_").cast("double") / float(1 << 64) + 0.5) * parts))
    below = share(F.lit(math.ceil((nulls + 1) / rows)))
    if not n:
        return F.lit(-1), below
    parts = max(1, math.ceil(n / (rows * segments)))
    bounds = sorted(bounds)
    single = sorted(set(bounds))
    table = F.array(*[F.struct(F.lit(b).alias("low"), F.lit(nxt).alias("high"), F.lit(bounds.count(b) - 1).alias("own")) for b, nxt in zip(single, [*single[1:], single[-1] + max(1, single[-1] - single[-min(2, len(single))])], strict=True)])
    d = F.col("doc_id")
    at = F.greatest(F.size(F.filter(F.array(*map(F.lit, single)), lambda b: b <= d)), F.lit(1))
    here = F.element_at(table, at)
    hot = (d == here["low"]) & (here["own"] > 0)
    inner = F.floor((d - here["low"]).cast("double") / (here["high"] - here["low"]).cast("double") * parts)
    inside = F.when(hot, share((here["own"] * parts).cast("long"))).otherwise(here["own"] * parts + F.least(F.lit(parts - 1), F.greatest(F.lit(0), inner)))
    return F.when(d.isNull(), -1).otherwise(at), F.when(d.isNull(), below).otherwise(inside).cast("long")


def fingerprint(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures, size_class)``.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document's,
    by descending ``doc_id``; the last document's next is the first, and a single document follows itself. Null texts are empty, and
    an empty text has an empty fingerprint; two empty ones are alike (1). Null ids sort below all others, rows of one id by
    text hash. Very long texts are taken whole. Other columns are ignored. No documents: no rows.

    Texts are shuffled once, by range of ids: a window sees one range, and the lowest document of a range gets the
    highest of the range below. Which range that is comes from a narrow row a range, ordered segment by segment. Rows that repeat both
    an id and its text share a range, whatever their number.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h_", F.xxhash64("text"))
    segment, inside = id_range(base)
    ranged = base.withColumn("g_", segment).withColumn("r_", inside).repartition("g_", "r_")
    up = Window.partitionBy("g_", "r_").orderBy("doc_id", "h_")
    here = with_signatures(ranged, "text", "sigs").withColumn("below", F.lag(F.struct("text", "sigs")).over(up))
    # the same exchange feeds the highest document of each range
    tops = ranged.withColumn("above_", F.lead("h_").over(up)).where("above_ is null").drop("above_")
    ranges = stored(base.select(segment.alias("g_"), inside.alias("r_")).distinct(), spark)
    inner = ranges.select("g_", "r_", F.lag("r_").over(Window.partitionBy("g_").orderBy("r_")).alias("from_r"))
    ends = ranges.groupBy("g_").agg(F.max("r_").alias("end_r"))  # a row a segment
    before = ends.select("g_", F.lag("g_").over(Window.orderBy("g_")).alias("p_g"), F.lag("end_r").over(Window.orderBy("g_")).alias("p_r"), F.max(F.struct("g_", "end_r")).over(Window.partitionBy()).alias("last_"))
    before = before.select("g_", F.coalesce("p_g", "last_.g_").alias("p_g"), F.coalesce("p_r", "last_.end_r").alias("p_r"))
    steps = inner.join(before, "g_").select(F.col("g_").alias("to_g"), F.col("r_").alias("to_r"), F.when(F.col("from_r").isNull(), F.col("p_g")).otherwise(F.col("g_")).alias("g_"), F.coalesce("from_r", "p_r").alias("r_"))
    over = with_signatures(tops, "text", "sigs").select("g_", "r_", F.struct("text", "sigs").alias("over_")).join(steps, ["g_", "r_"]).select("to_g", "to_r", "over_")
    # both sides are dealt by range already, so this join moves no text but the highest documents'
    both = here.join(over, F.expr("g_ = to_g and r_ = to_r"), "left").withColumn("below", F.coalesce("below", "over_")).drop("to_g", "to_r", "over_")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    both = both.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("below.text"), F.lit(1), half)))
    both = with_signatures(both.drop("text"), "edited", "edited_sigs")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed(F.col("sigs")).alias("fingerprint"), printed(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("below.sigs")).alias("near_next"),
        F.size("sigs").alias("n_signatures"), set_partition(F.size("sigs"), 0.8).alias("size_class"))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"), spark)
