import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataframe.llm import importance

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, orders):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return len(ws), [" ".join(ws[i : i + k]) for k in range(1, orders + 1) for i in range(len(ws) - k + 1)]


def plain(docs, target, orders=1, buckets=10_000, percent=10, least_words=20, seed=2024):
    """The same by dictionaries: rows (doc_id, n_features, weight, score) and the ranks of those drawn."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in grams(x, orders)[1]) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    rows, able = [], []
    for doc_id, text in docs:
        n, gs = grams(text, orders)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, gs))
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(gs), weight, score))
        if n >= least_words:
            able.append((-score, -math.inf if doc_id is None else doc_id))
    able.sort()
    return rows, [(i, -score) for score, i in able[: percent * len(able) // 100]]


@pytest.fixture(scope="module")
def target(make):
    return make([("the stone river cloud amber tide stone river",), (None,), ("",), ("Zwölf Ünïcödé words, the END 42",)], "text string")


@pytest.mark.parametrize("given", [{}, {"orders": 2, "buckets": 50, "percent": 60, "least_words": 3}, {"orders": 3, "percent": 100, "least_words": 2, "seed": 5}, {"orders": 3, "least_words": 0, "percent": 35}])
def test_same_as_plain(spark, odd, target, given):
    rows = importance.resample(odd.repartition(3), target, spark, **given).collect()
    want, drawn = plain([(r.doc_id, r.text) for r in odd.collect()], [r.text for r in target.collect()], **given)
    assert sorted(map(str, ((r.doc_id, r.n_features, r.weight, r.score) for r in rows))) == sorted(map(str, want))
    got = sorted(((r["rank"], r.doc_id, r.score) for r in rows if r["rank"] is not None), key=lambda x: x[0])
    assert [x[0] for x in got] == list(range(1, len(drawn) + 1))
    assert [(-math.inf if d is None else d, s) for _, d, s in got] == drawn


def test_ranks_over_many_ranges_and_equal_rows(spark, make):
    r = random.Random(8)
    rows = [(r.randint(0, 30) if i % 3 else 7, i) for i in range(4000)]
    df = make(rows, "score long, doc_id long").withColumns({c: F.lit("own") for c in ("part_", "n_", "before_")}).repartition(16)
    got = importance.ranked(df, spark, [F.desc("score"), F.asc("doc_id")], "place").orderBy("place").collect()
    assert [(x.score, x.doc_id) for x in got] == sorted(rows, key=lambda x: (-x[0], x[1])) and [x.place for x in got] == list(range(1, 4001)) and got[0].part_ == "own"


def test_empty_tables_and_bad_values(spark, none, odd, target):
    assert importance.resample(none, target, spark).count() == 0
    rows = importance.resample(odd, target.where("false"), spark).collect()
    assert sorted(map(str, ((r.doc_id, r.n_features, r.weight, r.score) for r in rows))) == sorted(map(str, plain([(r.doc_id, r.text) for r in odd.collect()], [])[0]))
    for bad in ({"orders": 0}, {"buckets": 0}, {"buckets": 1 << 30}, {"percent": 101}):
        with pytest.raises(ValueError):
            importance.resample(odd, target, spark, **bad)


def test_one_order_needs_no_window(spark, odd):
    plan = lambda n: importance.features(importance.positions(odd), n, 100)._jdf.queryExecution().toString()
    assert "Window" not in plan(1) and "Window" in plan(2)
