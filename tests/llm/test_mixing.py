import pytest
from pyspark.sql import functions as F

from strataframe.llm import mixing


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, active, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while active and left > 1e-9:
        whole = sum(w[s] for s in active)
        for s in active:
            out[s] += left * w[s] / whole
        left = 0.0
        for s in sorted(active, key=str):
            if out[s] >= most * sizes[s]:
                left += out[s] - most * sizes[s]
                out[s] = most * sizes[s]
                active.discard(s)
    return out


def check(rows):
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    target = slow_targets(sizes)
    for s in sizes:
        mine = [r for r in rows if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert mine[0].target == pytest.approx(target[s], abs=1e-6)
        near(mine, target[s])
    assert all(0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in rows)


def near(rows, target):
    """Within a hundredth of the target, or of half the smallest document that could be taken once more or less."""
    least = min((r.size for r in rows if r.size), default=0)
    assert abs(sum(r.taken for r in rows) - target) <= max(target / 100, least / 2) + 1e-6


def test_odd_rows(spark, odd):
    a = mixing.mix(odd, spark)
    assert a.count() == odd.count()
    words = {str(r.doc_id): len((r.text or "").encode().split()) for r in odd.collect() if r.doc_id is not None}
    assert all(words[str(r.doc_id)] == r.size for r in a.collect() if r.doc_id is not None)


def test_targets(spark, make):
    rows = [(i, " ".join(["w"] * (1 + (i * i) % 97)), "en", f"s{i % 7}" if i % 7 else None, 1) for i in range(600)] + [(10_000 + i, "w " * 300, "en", "s1", 1) for i in range(300)]
    docs = make(rows)
    out = mixing.mix(docs, spark)
    check(out.join(docs.select("doc_id", "source"), "doc_id").collect())
    again = mixing.mix(docs.repartition(3), spark)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_small_cases(spark, make, none):
    assert mixing.mix(none, spark).count() == 0
    assert [r.taken for r in mixing.mix(make([(1, None, None, None, None)]), spark).collect()] == [0]
    one = mixing.mix(make([(i, "a b c", None, "only", None) for i in range(10)]), spark).agg(F.sum("taken"), F.max("target")).first()
    assert one[1] == 45.0 and abs(one[0] - 45) <= 3


@pytest.mark.parametrize("first", [1, 500, 90_000, 123_456])
def test_one_document_of_a_third_or_half_of_its_source(spark, make, first):
    """A long document that does not fit what is open stops nothing; one that must be taken is, and smaller ones give way."""
    docs = [(first + i, "w " * 100, "en", "one", 1) for i in range(1000)] + [(first + 5000, "w " * 50_000, "en", "one", 1)]
    docs += [(first + 6000 + i, "w " * 40, "en", "two", 1) for i in range(25)] + [(first + 7000, "w " * 1000, "en", "two", 1)]
    docs += [(first + 8000, "w " * 3000, "en", "three", 1), (first + 8001, "w " * 2999, "en", "three", 1), (first + 8002, "w " * 7, "en", None, 1)]
    df = make(docs)
    rows = mixing.mix(df, spark).join(df.select("doc_id", "source"), "doc_id").collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    target = slow_targets(sizes)
    for s in ("one", "two", None):
        near([r for r in rows if r.source == s], target[s])
    assert all(r.copies <= 2 for r in rows)


def slow_extras(sizes, more):
    """Best sum of some of the documents: nearest to ``more`` of all there are."""
    sums = {0}
    for z in sizes:
        sums |= {x + z for x in sums}
    return min(abs(more - x) for x in sums)


def test_rounds_come_near_the_best(spark):
    """Random sizes: the rounds leave no more than the best choice of documents does, and half of the least document."""
    import random

    r = random.Random(5)
    cases = {str(k): [r.choice([1, 2, 3, 5, 8, 40, 41, 100, 700]) * r.randint(1, 5) for _ in range(r.randint(1, 14))] for k in range(120)}
    sizes = spark.createDataFrame([(k, z, v.count(z)) for k, v in cases.items() for z in set(v)], "source string, size long, m long")
    sources = spark.createDataFrame([(k, sum(v), r.random() * sum(v)) for k, v in cases.items()], "source string, source_size long, more double")
    more = {x.source: x.more for x in sources.collect()}
    got, left = mixing.extra_copies(sizes, sources, spark).collect(), {}
    assert all(0 <= x.n <= x.m for x in got)
    for x in got:
        left[x.source] = left.get(x.source, more[x.source]) - x.n * x["size"]
    worse = [abs(left[k]) - slow_extras(cases[k], more[k]) for k in cases]
    assert max(abs(left[k]) / max(cases[k]) for k in cases) <= 0.5 and sum(w <= 1 for w in worse) >= 60


def test_equal_rows_are_split(spark, make, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 8)
    docs = make([(None, "a b c", "en", "s", 1)] * 101 + [(5, "a b c", "en", "s", 1)] * 20 + [(6, "x", "en", "t", 1)] * 9)
    rows = mixing.mix(docs, spark).collect()
    assert len(rows) == 130 and sum(r.taken for r in rows if r.size == 3) == pytest.approx(rows[0].target if rows[0].size == 3 else [r for r in rows if r.size == 3][0].target, abs=2)
