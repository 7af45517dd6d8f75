"""Operator 6: mix sources to target token weights by entropy balancing. DataFrame functions only.

The mixture minimises sum(size * rate * log(rate)) - size * rate over document rates, subject to one token
constraint a source: sum(size * rate) = target. Its solution is rate = exp(lambda[source]), an exponential
tilt of every document of that source; lambda solves the convex dual, whose gradient and Hessian need
only sum(size) and sum(size * rate) of each source. One distributed aggregation gives those, and the
Newton steps then run on the table of sources as column expressions.

Rates become whole copies without drawing at random for each document: a source gives ``floor(rate)`` copies of every document, and one more to the fractional
part of its documents of each size. What rounding leaves of the target goes to whole documents, the largest that fit first, until less than
a document is open; where only a larger one is left and comes nearer, it is taken and smaller ones give way. Which documents of a size
get the copy is by seeded hash order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.llm.shared import WORD, stored, table

#: Source weights, in order of the source's code points, repeating.
CYCLE = (3, 1, 2)
#: Documents that a window orders at a time, about.
PART = 1024
#: Rounds of filling what is open; each leaves less than half of it.
ROUNDS = 12
#: Equal rows that one task writes at a time.
RUN = 4096


def order_key(doc_id: str, text: str, seed: str) -> Column:
    """32 seeded hash bits of an id, in a form that other SQL engines share. A null id goes by its text, so that many of them spread."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 8), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: tuple = CYCLE, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``totals(source, source_size)`` with ``weight`` and ``target``: ``share`` of all tokens dealt by weight, no target above
    ``most`` times its source, the excess dealt again by weight until none is above.

    The table has a row a source (a catalogue, not documents), so ranking it in one task is bounded.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every, up_to = Window.partitionBy(), Window.orderBy("full_at", F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("weight", cycle).withColumn("most", F.col("source_size") * F.lit(float(most)))
    t = t.withColumn("full_at", F.col("most") / F.col("weight")).withColumn("goal", F.sum("source_size").over(every) * F.lit(float(share)))
    before = up_to.rowsBetween(Window.unboundedPreceding, -1)
    # with the sources that fill up earlier at their limit, the rest get `level` tokens for each unit of weight
    t = t.withColumn("level", (F.col("goal") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    t = t.withColumn("full", F.col("full_at") <= F.col("level"))
    left = F.col("goal") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(every)
    t = t.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * left / F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)))
    return t.select("source", "source_size", "weight", "target")


def tilts(targets: DataFrame, steps: int = 60) -> DataFrame:
    """Adds ``rate`` = exp(lambda), lambda by Newton on the dual of each source's token constraint, from 0.

    Where no token can be wanted or had (target or size 0) the rate is 0.
    """
    newton = F.expr(f"aggregate(sequence(1, {int(steps)}), 0D, (l, i) -> l - (source_size * exp(l) - target) / (source_size * exp(l)))")
    return targets.withColumn("rate", F.when((F.col("target") > 0) & (F.col("source_size") > 0), F.exp(newton)).otherwise(0.0))


def _round(t: DataFrame) -> DataFrame:
    """One round over ``t(source, size, m, n, more)``, a row a source and size: ``n`` of ``m`` documents have a copy more, which should hold ``more`` words together.

    What is open goes to the largest documents that fit it, or comes back from them; if none fits, the smallest that brings the source nearer changes sides.
    """
    mine, larger = Window.partitionBy("source"), Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("open", F.col("more") - F.sum(F.col("n") * F.col("size")).over(mine)).withColumn("gap", F.abs("open"))
    t = t.withColumn("can", F.when(F.col("size") > 0, F.when(F.col("open") > 0, F.col("m") - F.col("n")).otherwise(F.col("n"))).otherwise(0))
    fit = (F.col("can") > 0) & (F.col("size") <= F.col("gap"))
    t = t.withColumn("before", F.coalesce(F.sum(F.when(fit, F.col("can") * F.col("size"))).over(larger), F.lit(0)))
    t = t.withColumn("some", F.max(fit).over(mine)).withColumn("over", F.min(F.when((F.col("can") > 0) & (F.col("size") > F.col("gap")) & (F.col("size") < 2 * F.col("gap")), F.col("size"))).over(mine))
    filled = F.greatest(F.lit(0), F.least("can", F.floor((F.col("gap") - F.col("before")) / F.col("size"))))
    moved = F.when(fit, filled).when(~F.col("some") & (F.col("size") == F.col("over")), 1).otherwise(0)
    return t.withColumn("n", F.col("n") + F.when(F.col("open") > 0, moved).otherwise(-moved)).select("source", "size", "m", "n", "more", moved.alias("moved"))


def extra_copies(sizes: DataFrame, sources: DataFrame, spark: SparkSession, rounds: int = ROUNDS) -> DataFrame:
    """``sizes(source, size, m)`` and ``sources(source, source_size, more)`` to ``(source, size, m, n)``: how many of the ``m`` documents of a size get one copy more.

    A window holds a source's sizes, which are numbers of words and not documents. Rounds end when nothing moves.
    """
    t = sizes.join(sources.select(F.col("source").alias("s_"), "source_size", "more"), F.expr("source <=> s_"))
    share = F.when(F.col("source_size") > 0, F.col("more") / F.col("source_size")).otherwise(0.0)
    t = t.withColumn("n", F.least("m", F.floor(F.col("m") * share))).select("source", "size", "m", "n", "more")
    t = stored(t, spark)
    for _ in range(rounds):
        t = stored(_round(t), spark)
        if t.where("moved > 0").isEmpty():
            break
        t = t.drop("moved")
    return t.select("source", "size", "m", "n")


def mix(docs: DataFrame, spark: SparkSession, seed: str = "mix", share: float = 1.5, most: float = 2.0, weights: tuple = CYCLE, rounds: int = ROUNDS) -> DataFrame:
    """``docs(doc_id, text, source)`` to ``(doc_id, size, source_size, target, rate, copies, taken)``, a row a document.

    Null texts have size 0; the null source is a source of its own, last. Documents of size 0 take the copies of their source's share and add nothing. Repeated ids
    stay rows of their own; null ids are placed by their texts. Very long texts are counted whole. Reruns agree. No documents: no rows. Other columns are ignored.

    With one token constraint a source the dual is separable: the rate is constant within a source, and the Newton steps lead to the logarithm of
    target over size. The table of sources is ranked in one task; it is a catalogue, not a row a document. Rows that are equal in id, text and source are one row with
    their number until the end, where many of them are written by many tasks.
    """
    most_ = int(most)
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), order_key("doc_id", "text", seed).alias("k"))
    rows = stored(sized.groupBy("source", "size", "k", "doc_id").agg(F.count("*").alias("c")), spark)
    sizes = stored(rows.groupBy("source", "size").agg(F.sum("c").alias("m")), spark)
    src = tilts(source_targets(sizes.groupBy("source").agg(F.sum(F.col("m") * F.col("size")).alias("source_size")), weights, share, most))
    src = src.withColumn("base", F.least(F.lit(most_), F.floor(F.col("rate") + 1e-9)))
    src = stored(src.withColumn("more", F.when(F.col("base") < most_, F.greatest(F.lit(0.0), F.col("target") - F.col("base") * F.col("source_size"))).otherwise(0.0)), spark)
    want = stored(extra_copies(sizes, src, spark, rounds).withColumn("parts", F.ceil(F.col("m") / PART)), spark)
    rows = rows.join(want.select(F.col("source").alias("s_"), F.col("size").alias("z_"), "m", "n", "parts"), F.expr("source <=> s_ and size = z_")).drop("s_", "z_")
    # the first n of each size, in hash order: offsets of its parts, and a window over each part
    some = rows.where("n > 0 and n < m").withColumn("part", F.shiftright(F.col("k") * F.col("parts"), 32))
    whole = Window.partitionBy("source", "size").orderBy("part")
    ahead = some.groupBy("source", "size", "part").agg(F.sum("c").alias("q")).withColumn("ahead", F.sum("q").over(whole) - F.col("q"))
    some = some.join(ahead.select(F.col("source").alias("s_"), F.col("size").alias("z_"), F.col("part").alias("p_"), "ahead"), F.expr("source <=> s_ and size = z_ and part = p_"))
    within = Window.partitionBy("source", "size", "part").orderBy("k", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    got = F.greatest(F.lit(0), F.least("c", F.col("n") - F.col("ahead") - F.coalesce(F.sum("c").over(within), F.lit(0))))
    names = ["doc_id", "source", "size", "c"]
    rows = some.select(*names, got.alias("x")).unionByName(rows.where("n = 0 or n = m").select(*names, F.when(F.col("n") > 0, F.col("c")).otherwise(0).alias("x")))
    rows = rows.join(src.withColumnRenamed("source", "s_"), F.expr("source <=> s_"))
    kinds = F.array(F.struct((F.col("base") + 1).alias("copies"), F.col("x").alias("rows")), F.struct(F.col("base").alias("copies"), (F.col("c") - F.col("x")).alias("rows")))
    rows = rows.select("doc_id", "size", "source_size", "target", "rate", F.inline(F.filter(kinds, lambda e: e["rows"] > 0)))
    many = rows.where(f"rows > {RUN}").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(RUN).cast("long"))))
    many = many.repartition("doc_id", "size", "at").withColumn("rows", F.least(F.lit(RUN), F.col("rows") - F.col("at"))).drop("at")
    out = rows.where(f"rows <= {RUN}").unionByName(many).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.select("doc_id", "size", "source_size", "target", "rate", F.col("copies").cast("int").alias("copies"), (F.col("size") * F.col("copies")).alias("taken"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), spark).drop("rate")


def _sql() -> str:
    """The same mixture in SQL: targets by the level that the sources left reach, shares of each size, the rounds one after another, ranks in hash order."""
    ctes = [
        """d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) size, cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '#' || md5(coalesce(text, '')))), 1, 8) as bigint) k from documents)""",
        """s0 as (select source, cast(sum(size) as bigint) source_size, cast(list_extract([3, 1, 2], cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)) as double) weight from d group by source)""",
        """s1 as (select *, source_size * 2.0::double most, source_size * 2.0::double / weight full_at, sum(source_size) over () * 1.5::double goal from s0)""",
        """s2 as (select *, full_at <= (goal - coalesce(sum(most) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) filled from s1 window w as (order by full_at, source nulls last rows between unbounded preceding and 1 preceding))""",
        """s3 as (select *, case when filled then most else weight * (goal - sum(case when filled then most else 0 end) over ()) / sum(case when not filled then weight end) over () end target from s2)""",
        """s4 as (select source, source_size, target, cast(case when source_size > 0 and target > 0 then least(2, floor(target / source_size + 1e-9)) else 0 end as bigint) base from s3)""",
        """s as (select *, case when base < 2 then greatest(0.0::double, target - base * source_size) else 0.0::double end more from s4)""",
        """t0 as materialized (select d.source, d.size, count(*) m, any_value(more) more, least(count(*), cast(floor(count(*) * any_value(case when source_size > 0 then more / source_size else 0 end)) as bigint)) n from d join s on d.source is not distinct from s.source group by 1, 2)""",
    ]
    for i in range(ROUNDS):
        ctes += [
            f"""a{i} as (select *, more - sum(n * size) over (partition by source) as opened from t{i})""",
            f"""b{i} as (select *, abs(opened) gap, case when size = 0 then 0 when opened > 0 then m - n else n end can from a{i})""",
            f"""c{i} as (select *, can > 0 and size <= gap fit, case when can > 0 and size > gap and size < 2 * gap then size end bigger from b{i})""",
            f"""e{i} as (select *, bool_or(fit) over (partition by source) any_fit, min(bigger) over (partition by source) least_bigger,
  coalesce(sum(case when fit then can * size end) over (partition by source order by size desc rows between unbounded preceding and 1 preceding), 0) before from c{i})""",
            f"""t{i + 1} as materialized (select source, size, m, more, n + (case when opened > 0 then 1 else -1 end) * (case when fit then greatest(0, least(can, cast(floor((gap - before) / size) as bigint))) when not any_fit and size = least_bigger then 1 else 0 end) n from e{i})""",
        ]
    ctes.append(f"""r as (select d.doc_id, d.source, d.size, n, row_number() over (partition by d.source, d.size order by k, doc_id) p from d join t{ROUNDS} t on d.source is not distinct from t.source and d.size = t.size)""")
    return "with " + ",\n ".join(ctes) + "\nselect doc_id, cast(size as bigint) size, source_size, target, cast(base + (p <= n)::int as int) copies, cast(size * (base + (p <= n)::int) as bigint) taken from r join s on r.source is not distinct from s.source"


SQL = _sql()
