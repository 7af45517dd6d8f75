"""Operator 1: embedding near-dedup over a robust-pruned flat graph.

Vectors of a label are dealt to overlapping cluster shards (each to its ``SPREAD`` nearest cells of a k-means tree); each shard's graph is built by
itself and a vector's adjacency lists from its shards are united. Every vector is then searched for: greedily from the shard's medoid, expanding
the range until nothing new is in it, each link verified by its exact cosine in double precision. Recall is audited against
brute force for a sample of queries over all rows, label by label where one has enough pairs; where it is too low, vectors are dealt to twice as many
shards and searched for with twice the beam. If recall stays too low, there is no result but an error.

A label of any size has shards of about ``SHARD`` vectors: cells that hold more are split again, each from a bounded sample of its own, so neither a
label's centroids nor its vectors ever meet in one task. Only a cell so tight that most of its pairs link is not split; its shard is cut in parts by
hash, and each part is searched for in each, which is work in proportion to its links. Equal vectors are one row for all of this. No pair leaves its
task: links go out as one count and one link of a spanning forest for each vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.llm import graph
from strataframe.llm.components import connected_components
from strataframe.llm.shared import dropped, stored, table

#: Vectors that a shard aims at, each vector counting once for each of its shards; twice as many are one task's.
SHARD = 512
#: Children of a cell at most, vectors of the k-means sample for each child, and levels of the tree (64 ** 6 cells).
FAN, SAMPLE, LEVELS = 64, 64, 6
#: Queries of a recall audit (so many of all vectors and so many of linked ones), the recall below which the search is repeated, and the true
#: links from which a label is judged by itself.
AUDIT, RECALL, JUDGED = 192, 0.95, 40
#: Shards of a vector at first and at most, and the beams that go with them.
SPREAD, WIDEST, BEAM, WIDEST_BEAM = 2, 32, 16, 1024


def valid(vectors: DataFrame) -> DataFrame:
    """Rows that can link: with an id, a label, and a vector of finite components, not all zero."""
    ok = F.expr("vec_id is not null and label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    return vectors.where(ok).select("vec_id", "label", "embedding")


def representatives(vectors: DataFrame) -> DataFrame:
    """``(label, dim, embedding, rep, first, n)``: each distinct vector of a label, its smallest id, its number of ids, and a number of its own.

    The numbers hold only once the table is written, as a task that is run again may give others.
    """
    one = valid(vectors).dropDuplicates(["vec_id", "label", "embedding"])
    each = one.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    return each.select("label", F.size("embedding").alias("dim"), "embedding", F.monotonically_increasing_id().alias("rep"), "first", "n")


def _unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, least: float, rounds: int = 6) -> np.ndarray:
    """Centroids of unit rows; of those whose cells are tight and that are near each other, which would cut a group of near copies, one stays."""
    centers = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(rounds):
        sim = x @ centers.T
        at = sim.argmax(axis=1)
        for c in range(len(centers)):
            if (at == c).any():
                m = x[at == c].mean(axis=0)
                centers[c] = m / max(np.linalg.norm(m), 1e-12)
    sim = x @ centers.T
    at = sim.argmax(axis=1)
    tight = np.array([(at == c).any() and sim[at == c, c].mean() >= math.sqrt(least) for c in range(len(centers))])
    stay: list[int] = []
    for c in range(len(centers)):
        if not (tight[c] and any(tight[o] and centers[o] @ centers[c] >= least for o in stay)):
            stay.append(c)
    return centers[stay]


def dealt(own: DataFrame, spark: SparkSession, least: float, spread: int = SPREAD, shard: int = SHARD, fan: int = FAN) -> DataFrame:
    """``(rep, shards)``: the sorted numbers of the ``spread`` nearest cells of each vector, in the tree of its label and length.

    Each level splits the cells that hold over twice ``shard`` vectors: centroids come from ``SAMPLE`` vectors a child, drawn by hash, and every
    vector goes down from its nearest cells (at least four), so that it can end beyond its parent's border. Cells are split in groups of
    bounded size; a level costs one shuffle of the vectors in such cells.
    """
    wide = max(4, spread)
    label = own.schema["label"].dataType.simpleString()
    at = stored(own.select("rep", "label", "dim", F.lit(0).cast("long").alias("cell"), F.lit(1.0).alias("sim"), F.lit(1).alias("rank"), F.lit(False).alias("whole")), spark)
    key = ["label", "dim", "cell"]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", ignore_index=True)
        x = _unit(rows["embedding"])
        found = _kmeans(x, min(int(rows["k"].iat[0]), len(x)), least)
        return pd.DataFrame({**{c: [rows[c].iat[0]] * len(found) for c in key}, "child": range(len(found)), "center": list(found)})

    def descend(rows: pd.DataFrame, centers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(centers):
            return pd.DataFrame({"rep": [], "label": [], "dim": [], "parent": [], "child": [], "sim": []})
        centers = centers.sort_values("child", ignore_index=True)
        sim = _unit(rows["embedding"]) @ np.array(centers["center"].tolist()).T
        m = min(wide, len(centers))
        near = np.argpartition(-sim, m - 1, axis=1)[:, :m]
        return pd.DataFrame({"rep": np.repeat(rows["rep"].to_numpy(), m), "label": rows["label"].iat[0], "dim": rows["dim"].iat[0], "parent": rows["cell"].iat[0], "child": near.ravel(), "sim": np.take_along_axis(sim, near, 1).ravel()})

    for _ in range(LEVELS):
        sizes = at.where("not whole").groupBy(*key).agg(F.count_if(F.col("rank") <= spread).alias("many"), F.count("*").alias("every")).where(F.col("many") > 2 * shard)
        sizes = stored(sizes.withColumn("k", F.least(F.lit(fan), F.ceil(F.col("many") * F.lit(spread / shard)).cast("int"))), spark)
        if sizes.isEmpty():
            break
        rows = at.where("not whole").join(sizes, key).join(own.select("rep", "label", "dim", "embedding"), ["rep", "label", "dim"])
        rows = rows.withColumn("h", F.xxhash64(F.lit(5), "rep"))
        some = rows.where(F.pmod("h", F.lit(1 << 20)) < F.lit(float(SAMPLE << 20)) * F.col("k") / F.col("every"))
        centers = stored(some.select(*key, "k", "rep", "embedding").groupBy(*key).applyInPandas(fit, f"label {label}, dim int, cell long, child int, center array<double>"), spark)
        children = centers.groupBy(*key).agg(F.count("*").alias("n"))
        split = stored(sizes.join(children.where("n > 1").select(key), key), spark)
        groups = F.ceil(F.col("every") / F.lit(4096)).cast("int")
        dealt_ = rows.join(split.select(*key), key, "left_semi").withColumn("salt", F.pmod(F.shiftright("h", 20), groups).cast("int")).select(*key, "salt", "rep", "embedding")
        salted = centers.join(split, key).withColumn("salt", F.explode(F.sequence(F.lit(0), groups - 1))).select(*key, "salt", "child", "center")
        down = dealt_.groupBy(*key, "salt").cogroup(salted.groupBy(*key, "salt")).applyInPandas(descend, f"rep long, label {label}, dim int, parent long, child int, sim double")
        # numbers of children are hashes of the parent's and the child's
        down = down.select("rep", "label", "dim", F.shiftrightunsigned(F.xxhash64("parent", "child"), 1).alias("cell"), "sim", F.lit(False).alias("whole"))
        marks = split.select(*key, F.lit(True).alias("split_"))
        whole = sizes.join(children.where("n = 1").select(key), key).select(*key, F.lit(True).alias("tight_"))
        rest = at.join(marks, key, "left").where("split_ is null").join(whole, key, "left").select("rep", "label", "dim", "cell", "sim", (F.col("whole") | F.coalesce("tight_", F.lit(False))).alias("whole"))
        best = Window.partitionBy("label", "dim", "rep").orderBy(F.desc("sim"), "cell")
        after = stored(rest.unionByName(down).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= wide), spark)
        for t in (at, sizes, centers, split):
            dropped(t, spark)
        at = after
    return at.where(F.col("rank") <= spread).groupBy("label", "dim", "rep").agg(F.array_sort(F.collect_list("cell")).alias("shards"))  # `spread` numbers at most


def graphs(parts: DataFrame) -> DataFrame:
    """``(rep, near)``: the united adjacency lists of each vector, from the graphs of the parts it is in."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep", ignore_index=True)
        ids, g = part["rep"].to_numpy(), graph.build(_unit(part["embedding"]))
        return pd.DataFrame({"rep": ids, "near": [ids[row[row >= 0]] for row in g]})

    lists = parts.select("label", "dim", "shard", "part", "rep", "embedding").groupBy("label", "dim", "shard", "part").applyInPandas(build, "rep long, near array<long>")
    return lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # a list of `degree` at most for each shard


def _block(rows: pd.DataFrame, least: float, beam: int) -> pd.DataFrame:
    """Links between the two parts of a block (or within the one): for each vector in one, its count and its group's smallest id.

    A pair that two shards hold is counted in the first of the shards that both vectors are in.
    """
    rows = rows.sort_values("rep", ignore_index=True)
    same = rows["i"].iat[0] == rows["j"].iat[0]
    ids, copies, x = rows["rep"].to_numpy(), rows["n"].to_numpy(), _unit(rows["embedding"])
    here = rows["shard"].iat[0]
    nodes = np.flatnonzero(rows["part"].to_numpy() == rows["i"].iat[0])
    asked = nodes if same else np.flatnonzero(rows["part"].to_numpy() == rows["j"].iat[0])
    empty = pd.DataFrame({"rep": ids[:0], "links": copies[:0], "root": ids[:0]})
    if not len(nodes) or not len(asked):
        return empty
    known = ids[nodes]
    lists = [np.asarray(v, np.int64) for v in rows["near"].to_numpy()[nodes]]
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    inside = known[at] == flat  # neighbours from the other shard that are in this part too stay
    owner = np.repeat(np.arange(len(nodes)), [len(v) for v in lists])[inside]
    at = at[inside]
    column = np.arange(len(owner)) - np.searchsorted(owner, owner)
    g = np.full((len(nodes), int(column.max(initial=0)) + 1), -1, np.int64)
    g[owner, column] = at
    q, n = graph.in_range(x[nodes], g, x[asked], np.arange(len(nodes)) if same else np.full(len(asked), -1), least, beam)
    a, b = asked[q], nodes[n]
    pair = np.unique(np.minimum(a, b) * len(ids) + np.maximum(a, b))
    a, b = pair // len(ids), pair % len(ids)
    a, b = a[a != b], b[a != b]
    if not len(a):
        return empty
    shards = np.full((len(ids), max(map(len, rows["shards"]))), -1, np.int64)
    for k, s in enumerate(rows["shards"]):
        shards[k, : len(s)] = s
    first, step = np.zeros(len(a), bool), max(1, 4_000_000 // shards.shape[1] ** 2)
    for s in range(0, len(a), step):
        p, q = shards[a[s : s + step]], shards[b[s : s + step]]
        both = (p[:, :, None] == q[:, None, :]) & (p >= 0)[:, :, None]
        first[s : s + step] = np.where(both.any(axis=2), p, np.iinfo(np.int64).max).min(axis=1) == here
    links = np.bincount(a[first], copies[b[first]], len(ids)) + np.bincount(b[first], copies[a[first]], len(ids))
    root = np.arange(len(ids))
    while True:  # the smallest member's number, by hooking and jumping; row numbers follow ids
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = np.unique(np.r_[a, b])
    return pd.DataFrame({"rep": ids[some], "links": links[some].astype(np.int64), "root": ids[root[some]]})


def searched(parts: DataFrame, near: DataFrame, least: float, beam: int) -> DataFrame:
    """``(rep, links, root)`` from every block of parts of every shard."""
    full = parts.join(near, "rep")
    blocks = full.withColumn("other", F.explode(F.expr("sequence(0, cast(of as int) - 1)")))
    blocks = blocks.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    return blocks.drop("of", "other").groupBy("label", "dim", "shard", "i", "j").applyInPandas(lambda rows: _block(rows, least, beam), "rep long, links long, root long")


def audit(reps: DataFrame, counts: DataFrame, spark: SparkSession, least: float) -> float:
    """Recall of the links of seeded queries, ``AUDIT`` of all vectors and ``AUDIT`` of those with links, found against all rows by brute force in
    blocks: the least of each sample's share of links, each sample's mean share by query (so that the many links of a large group hide nothing), and
    the share of any label of the first sample with ``JUDGED`` true links. Where the queries have no true link: 1.
    """
    full = reps.join(counts, "rep", "left").select("label", "dim", "embedding", "rep", F.coalesce("links", F.lit(0)).alias("links"))
    asked = [(k, r) for k, some in enumerate((full, full.where("links > 0"))) for r in some.orderBy(F.xxhash64(F.lit(17 + k), "rep")).limit(AUDIT).collect()]
    by: dict = {}
    for number, (_, r) in enumerate(asked):
        by.setdefault((r["label"], r["dim"]), []).append((number, r))
    shared = spark.sparkContext.broadcast({k: (np.array([i for i, _ in v]), np.array([r["rep"] for _, r in v]), _unit([r["embedding"] for _, r in v])) for k, v in by.items()})
    many = len(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(many, np.int64)
        for b in batches:
            at: dict = {}
            for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                at.setdefault(key, []).append(i)
            for key in at.keys() & shared.value.keys():
                some = b.take(pa.array(at[key]))
                numbers, ids, q = shared.value[key]
                hit = (_unit(some.column(2).to_pylist()) @ q.T >= least) & (some.column(3).to_numpy()[:, None] != ids[None, :])
                total[numbers] += (hit * some.column(4).to_numpy()[:, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(many), pa.int32()), pa.array(total, pa.int64())], ["query", "total"])

    totals = reps.select("label", "dim", "embedding", "rep", "n").mapInArrow(run, "query int, total long").groupBy("query").agg(F.sum("total").alias("total")).collect()
    true = np.zeros(many)
    for r in totals:
        true[r["query"]] = r["total"]
    got, sample = np.array([r["links"] for _, r in asked], float), np.array([k for k, _ in asked], int)
    shares = [1.0]
    for k in (0, 1):
        some = (sample == k) & (true > 0)
        if some.any():
            shares += [got[some].sum() / true[some].sum(), (got[some] / true[some]).mean()]
    for v in by.values():
        some = np.array([i for i, _ in v if sample[i] == 0], int)
        if true[some].sum() >= JUDGED:
            shares.append(got[some].sum() / true[some].sum())
    return float(min(shares))


def near_duplicates(vectors: DataFrame, spark: SparkSession, least: float = 0.93, shard: int = SHARD, beam: int = BEAM, fan: int = FAN) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` to ``(vec_id, n_links, component_id, kept, audited_recall)``, a row a row.

    Vectors of one label (and one length) link at a cosine of ``least`` or more; ``n_links`` counts the other vectors linked directly, equal ones
    included; ``component_id`` is the smallest id reachable. Rows with a null id or label, or a vector that is null,
    empty, zero or has null or non-finite components, link with nothing and are their own component. Rows that repeat an id with its
    vector are one vector; with another vector they are another. Other columns are ignored. No vectors: no rows. A recall that stays below ``RECALL`` raises.
    """
    own, spread = stored(representatives(vectors), spark), SPREAD
    while True:
        reps = stored(own.join(dealt(own, spark, least, spread, shard, fan), ["label", "dim", "rep"]).select("label", "dim", "embedding", "rep", "first", "n", "shards"), spark)
        each = reps.drop("first").select("*", F.explode("shards").alias("shard"))
        sizes = each.groupBy("label", "dim", "shard").agg(F.ceil(F.count("*") / F.lit(2 * shard)).alias("of"))
        parts = each.join(sizes, ["label", "dim", "shard"]).withColumn("part", F.pmod(F.xxhash64(F.lit(23), "rep"), F.col("of")).cast("int"))
        parts = stored(parts, spark)
        near = stored(graphs(parts), spark)
        found = stored(searched(parts, near, least, beam), spark)
        counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
        recall = audit(reps, counts, spark, least)
        if recall >= RECALL:
            break
        if spread >= WIDEST and beam >= WIDEST_BEAM:
            raise RuntimeError(f"recall {recall:.3f} stays below {RECALL} with every vector in {spread} shards and a beam of {beam}")
        for t in (reps, parts, near, found):
            dropped(t, spark)
        spread, beam = min(2 * spread, WIDEST), min(4 * beam, WIDEST_BEAM)
    groups = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), spark)
    named = reps.join(counts, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left").withColumn("part", F.coalesce("component_id", "rep"))
    names = named.groupBy("part").agg(F.min("first").alias("least"))
    named = named.join(names, "part").select(F.col("label").alias("l_"), F.col("embedding").alias("e_"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.col("least").alias("part"))
    # only valid vectors have a representative to meet
    out = vectors.select("vec_id", "label", "embedding").join(named, F.expr("vec_id is not null and label = l_ and embedding = e_"), "left")
    component = F.coalesce("part", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(float(recall)).alias("audited_recall"))


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), spark)


#: All pairs of a label, and their closure; the recall is 1, as links that equal these leave none out.
SQL = """with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 n as (select *, sqrt(list_dot_product(e, e)) norm from v),
 p as (select a.vec_id a, b.vec_id b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
 c as (select a, b from p union select c.a, p.b from c join p on c.b = p.a),
 l as (select a, count(*) n_links from p group by a), m as (select a, min(b) least_id from c group by a)
 select vec_id, coalesce(n_links, 0) n_links, least(vec_id, coalesce(least_id, vec_id)) component_id, vec_id = least(vec_id, coalesce(least_id, vec_id)) kept, 1.0::double audited_recall
 from embeddings left join l on vec_id = l.a left join m on vec_id = m.a"""
