import numpy as np
from pyspark.sql import functions as F

from strataframe.llm import ann
from tests.llm.test_simhash import slow_groups

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(n=900, seed=1, labels=3, dim=16):
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(size=dim).astype(np.float32).tolist(), int(i % labels)) for i in range(n)]
    hub = r.normal(size=dim)
    rows += [(2000 + i, (hub + 0.08 * r.normal(size=dim)).astype(np.float32).tolist(), 0) for i in range(200)]
    rows += [(3000 + i, rows[5][1], rows[5][2]) for i in range(40)] + [(4000, rows[5][1], 1 - rows[5][2] % 2), (4001, [2 * x for x in rows[7][1]], rows[7][2])]
    return rows


def truth(rows):
    ok = {i: (lab, np.array(v, float)) for i, v, lab in rows if v and lab is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    links, pairs = dict.fromkeys(ids, 0), []
    for key in {(ok[i][0], len(ok[i][1])) for i in ids}:
        mine = [i for i in ids if (ok[i][0], len(ok[i][1])) == key]
        x = np.array([ok[i][1] for i in mine])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
        for p, q in zip(a, b, strict=True):
            links[mine[p]] += 1
            links[mine[q]] += 1
            pairs.append((mine[p], mine[q]))
    return links, slow_groups(ids, pairs)


def check(rows, got, exact=True):
    links, group = truth(rows)
    for r in got:
        if r.vec_id is None or r.vec_id not in links:
            assert r.n_links == 0 and r.component_id == r.vec_id
            continue
        assert r.n_links <= links[r.vec_id]
        assert r.kept == (r.vec_id == r.component_id)
        if exact:
            assert (r.n_links, r.component_id) == (links[r.vec_id], group[r.vec_id])
    assert sum(r.n_links for r in got) >= 0.9 * sum(links.values())


def test_against_brute_force(spark):
    rows = table()
    check(rows, ann.near_duplicates(spark.createDataFrame(rows, SCHEMA), spark).collect())


def test_shards_and_parts(spark):
    """Small shards: many centroids, and shards that are cut into parts."""
    rows = table(seed=2)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("own")).withColumn("part", F.lit("own"))
    got = ann.near_duplicates(df, spark, shard=64).collect()
    check(rows, got, exact=False)
    assert got[0].audited_recall >= 0.9


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, None), (3, None, 0), (4, [], 0), (5, [0.0, 0.0, 0.0], 0), (6, [1.0, None, 3.0], 0), (7, [1.0, float("nan"), 3.0], 0), (8, [float("inf"), 1.0, 1.0], 0), (None, v, 0), (9, [2.0, 4.0, 6.0], 0), (10, [1.0, 2.0], 0), (11, [-1.0, -2.0, -3.0], 0), (12, [1e-30, 2e-30, 3e-30], 0), (1, v, 0), (13, [-0.0, 1.0, 0.0], 1), (14, [0.0, 1.0, 0.0], 1)]
    got = ann.near_duplicates(spark.createDataFrame(rows, SCHEMA), spark).collect()
    assert len(got) == len(rows)
    check([r for k, r in enumerate(rows) if k != 13], got)
    assert ann.near_duplicates(spark.createDataFrame([], SCHEMA), spark).count() == 0


def test_pairs_that_two_shards_do_not_hold(spark, monkeypatch):
    """Pairs just over the bound among many centroids that were not fitted to them, as in a large label: two shards a vector leave many pairs in none."""
    r = np.random.default_rng(8)
    x = r.normal(size=(800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.934 * x + np.sqrt(1 - 0.934**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(np.r_[x, y])]
    links, _ = truth(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    real = ann._kmeans
    c = r.normal(size=(60, 64))
    monkeypatch.setattr(ann, "_kmeans", lambda x, k, least: c / np.linalg.norm(c, axis=1, keepdims=True) if len(x) > 200 else real(x, k, least))
    own = ann.stored(ann.representatives(df), spark)
    two = {z.rep: set(z.shards) for z in ann.dealt(own, spark, 0.93, shard=64).collect()}
    number = {z["first"]: z.rep for z in own.collect()}
    assert max(map(len, two.values())) == 2
    apart = sum(not two[number[i]] & two[number[800 + i]] for i in range(800))
    got = ann.near_duplicates(df, spark, shard=64).collect()
    assert got[0].audited_recall >= ann.RECALL
    assert sum(z.n_links for z in got) >= 0.93 * sum(links.values()) and apart > 0


def test_levels_of_the_tree(spark):
    """A label of several levels: every cell within bounds but for the tight one, which is cut in parts."""
    r = np.random.default_rng(4)
    x, hub = r.normal(size=(1500, 16)), r.normal(size=16)
    x = np.r_[x, hub + 0.02 * r.normal(size=(200, 16))]
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    own = ann.stored(ann.representatives(df), spark)
    cells = [c for z in ann.dealt(own, spark, 0.93, shard=32, fan=4).collect() for c in z.shards]
    size = {c: cells.count(c) for c in set(cells)}
    assert len(size) > 4**2 and sorted(size.values())[-3] <= 64
    check(rows, ann.near_duplicates(df, spark, shard=32, fan=4).collect(), exact=False)


def test_one_id_with_two_vectors(spark):
    got = ann.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (0, [0.01, 1.0], 0)], SCHEMA), spark).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(0, 1, 0), (1, 1, 0), (1, 1, 1), (2, 1, 1)]
