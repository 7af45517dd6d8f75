"""Operator 12: importance resampling toward a target distribution, over hashed n-grams from a position table.

``posexplode`` makes a row a word and place, and for each order above 1 ``lead`` over a document's places adds the words that follow; the runs
are hashed into buckets, grouped into counts of the raw corpus and of the target, and the buckets' gains (logarithms of the ratio of
smoothed shares) join the rows again, whose sum by document is its weight. A seeded Gumbel number for each document on top of
its weight makes the highest scores a draw without replacement in proportion to the exponential of the weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.llm.shared import fresh, stored, table

#: Between words: all of ASCII but digits and small letters.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The gains go to every task; so many buckets are at most 16 MB.
MOST_BUCKETS = 1 << 20


def words(text: Column) -> Column:
    """A text's words, A-Z lower-cased. Null: none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, BREAKS), lambda w: w != "")


def positions(docs: DataFrame, row: str = "row_") -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, row_, pos, word)``, a row a word; a text without words has one row of nulls. ``row_`` tells rows apart that share an id.

    ``row_`` is a row's place in the scan: it holds within one job on a scan or a stored table, and is not for joins between jobs.
    """
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias(row), words(F.col("text")).alias("words_"))
    return rows.select("doc_id", row, F.posexplode_outer("words_").alias("pos", "word"))


def features(places: DataFrame, orders: int, buckets: int, row: str = "row_") -> DataFrame:
    """``positions`` to ``(doc_id, row_, bucket)``, a row a run of 1 to ``orders`` words; rows without words stay with a null bucket.

    Order 1 needs no neighbours, and so no window. Above it a document's words are one partition of the window, which one text bounds.
    """
    grams = [F.col("word")]
    if orders > 1:
        after = Window.partitionBy(row).orderBy("pos")
        places = places.withColumns({f"next{k}_": F.lead("word", k).over(after) for k in range(1, orders)})
        for k in range(1, orders):
            grams.append(F.concat(grams[-1], F.lit(" "), F.col(f"next{k}_")))  # null where the text ends before
        gram = F.explode(F.when(F.col("word").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array_compact(F.array(*grams))))
        places = places.select("doc_id", row, gram.alias("gram"))
    else:
        places = places.select("doc_id", row, F.col("word").alias("gram"))
    return places.select("doc_id", row, (F.crc32(F.col("gram").cast("binary")) % buckets).cast("int").alias("bucket"))


def bucket_counts(texts: DataFrame, orders: int, buckets: int) -> DataFrame:
    """``texts(text)`` to ``(bucket, n)``: runs by bucket. Counts combine before the shuffle, so a word that is a third of all words is one row a task."""
    return features(positions(texts.select(F.lit(0).alias("doc_id"), "text")), orders, buckets).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(raw: DataFrame, target: DataFrame, spark: SparkSession, buckets: int) -> DataFrame:
    """``(bucket, n)`` of corpus and target to ``(bucket, gain)``, a row for every bucket that either has."""
    both = raw.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full_outer").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    both = stored(both, spark)  # a row a bucket at most
    sums = both.agg(F.struct(F.sum("s").alias("S"), F.sum("t").alias("T"))).scalar()
    of = lambda c: F.col(c).cast("double")
    many = F.lit(float(buckets))
    ratio = ((of("t") + 1) * (of("all_.S") + many)) / ((of("s") + 1) * (of("all_.T") + many))
    return stored(both.withColumn("all_", sums).select("bucket", F.floor(F.log(ratio) * 1000).alias("gain")), spark)


def ranked(scored: DataFrame, spark: SparkSession, order: list[Column], name: str) -> DataFrame:
    """``scored`` with the rank (1, 2, 3 ...) of each row in ``order``, which should tell rows apart.

    Rows are dealt to ranges of the order and stored with their range; a small table of counts gives each range its offset, and a window sees one range.
    """
    part, n, before = fresh(scored, "part_", "n_", "before_")
    rows = stored(scored.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), spark)
    sizes = rows.groupBy(part).agg(F.count("*").alias(n))  # a row a range
    sizes = sizes.select(part, (F.sum(n).over(Window.orderBy(part)) - F.col(n)).alias(before))
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return rows.withColumn(name, place).join(sizes, part).withColumn(name, (F.col(name) + F.col(before)).cast("long")).drop(part, before)


def resample(docs: DataFrame, target: DataFrame, spark: SparkSession, orders: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``docs(doc_id, text)`` and ``target(text)`` to ``(doc_id, n_features, weight, score, rank)``, a row a document, all longs.

    Features are runs of 1 to ``orders`` words, repeats counted. Of the documents with ``least_words`` words or more, the ``percent`` highest scores (rounded down) are drawn and
    ranked, ties to the smaller id (a null id first, and equal ones in any order); ``rank`` is null for all others. Null and empty texts have no features and weight 0. A null id counts as
    an empty string for its random number. Repeated rows stay rows. Very long texts are taken whole; other columns are ignored. No documents: no rows. An
    empty target: gains toward what is rare.

    ``docs`` is read twice, for counts and for weights, and no word is stored or shuffled but as part of a sum (for orders above 1, once by document). What is broadcast is a row a bucket.
    """
    if not (orders >= 1 and 1 <= buckets <= MOST_BUCKETS and 0 <= percent <= 100):
        raise ValueError(f"orders from 1 on, 1 to {MOST_BUCKETS} buckets, 0 to 100 percent")
    gain = gains(bucket_counts(docs, orders, buckets), bucket_counts(target, orders, buckets), spark, buckets)
    rows = features(positions(docs.select("doc_id", "text")), orders, buckets).join(F.broadcast(gain), "bucket", "left")
    weighed = rows.groupBy("row_", "doc_id").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)
    # runs of k words are k - 1 fewer than words, so words are known from the number of features
    many = F.lit(orders * least_words - orders * (orders - 1) // 2 if least_words >= orders else least_words * (least_words + 1) // 2)
    scored = stored(weighed.withColumn("score", (F.col("weight") + gumbel).cast("long")).withColumn("able_", F.col("n_features") >= many), spark)
    able = scored.where("able_")
    drawn = F.floor(able.agg(F.count("*")).scalar() * percent / 100)
    placed = ranked(able, spark, [F.desc("score"), F.asc("doc_id"), F.asc("row_")], "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = placed.unionByName(scored.where("not able_").withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spark)


#: CRC-32 in SQL is a fold over a word's bytes with the table of the reflected polynomial, once for each distinct word.
SQL = r"""with recursive steps as (select i::bigint i, i::bigint c, 0 k from range(256) r(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8),
 crc as (select list(c order by i) x from steps where k = 8),
 w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
 e as (select doc_id, unnest(ws) word from w),
 b as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) word from benchmark),
 v as (select word, hex(encode(word)) hx from (select word from e union select word from b)),
 k as (select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(hx), 2), lambda i: cast('0x' || substr(hx, i, 2) as bigint))), lambda a, y: xor(a >> 8, x[(xor(a, y) & 255) + 1])), 4294967295) % 10000 bucket from v, crc),
 s as (select bucket, count(*) n from e join k using (word) group by 1),
 t as (select bucket, count(*) n from b join k using (word) group by 1),
 g as (select bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1.0::double) * ((select coalesce(sum(n), 0) from s) + 10000.0::double)) / ((coalesce(s.n, 0) + 1.0::double) * ((select coalesce(sum(n), 0) from t) + 10000.0::double)))) gain from s full join t using (bucket)),
 f as (select doc_id, count(*) n, sum(gain) wt from e join k using (word) join g using (bucket) group by 1),
 d as (select w.doc_id, coalesce(n, 0) n_features, cast(coalesce(wt, 0) as bigint) weight,
  cast(coalesce(wt, 0) as bigint) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || cast(w.doc_id as varchar)), 1, 8) as bigint) + 0.5::double) / 4294967296.0::double))) as bigint) score from w left join f on w.doc_id = f.doc_id),
 r as (select *, row_number() over (order by score desc, doc_id) p, count(*) over () m from d where n_features >= 20)
select d.doc_id, d.n_features, d.weight, d.score, case when r.p <= r.m * 10 // 100 then r.p end as rank from d left join r on d.doc_id = r.doc_id"""
