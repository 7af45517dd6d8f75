import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from strataframe.llm import spotsigs
from tests.llm.conftest import prose


def _murmur(value: int, seed: int) -> int:
    """Murmur3 of a long, as SQL's hash() has it."""
    m = 0xFFFFFFFF
    rotate = lambda x, r: (x << r | x >> 32 - r) & m
    h = seed & m
    for part in (value & m, value >> 32 & m):
        k = rotate(part * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
        h = (rotate(h ^ k, 13) * 5 + 0xE6546B64) & m
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


def plain_signatures(text: str) -> list[int]:
    words = [w for w in re.split(r"[\s.,;:!?]+", text.lower()) if w]
    if not words:
        return []
    code = lambda w: xxhash.xxh64_intdigest(w.encode(), 42) & ~1 | (w in spotsigs.ANCHORS)
    codes = [code(w) for w in words]

    def signature(anchor: int, at: int) -> int:
        h = _murmur(anchor, 42)
        for c in [c for c in codes[at : at + spotsigs.REACH] if c % 2 == 0][: spotsigs.CHAIN]:
            h = _murmur(c, h)
        return h

    found = {signature(1, 0)} | {signature(c, i + 1) for i, c in enumerate(codes) if c % 2 or (c >> 1) % spotsigs.ONE_IN == 0}
    return sorted(h - (1 << 32) if h >> 31 else h for h in found)


def test_signatures_against_plain(spark, make):
    texts = [prose(i, 5 + 17 * i) for i in range(20)] + ["", " ", "the", "the the of", "x", "No, stop words here! amber: amber; amber?", "mot de passe " * 30, "日本 語 " * 40]
    df = make([(i, t, None, None, None) for i, t in enumerate(texts)])
    got = {r.doc_id: r.s for r in spotsigs.with_signatures(df, "text", "s").collect()}
    assert [got[i] for i in range(len(texts))] == [plain_signatures(t) for t in texts]


def test_few_anchors_and_fewer_are_alike(spark):
    """Signatures of what two texts share are the same, however few of the words are anchors."""
    words = [f"word{i}" for i in range(380)]
    for k in range(0, 380, 19):
        words[k] = "the"
    a, b = " ".join(words), " ".join([*words[:-1], *(f"more{i}" for i in range(22))])
    x, y = (set(plain_signatures(t)) for t in (a, b))
    assert len(x & y) / len(x | y) > 0.85


def test_a_hot_id_is_cut_into_ranges(spark, make):
    """Rows of one id lie in many ranges, in order, and the texts that follow are those of a plain sort."""
    rows = [(7, f"text {i} of one id", None, None, None) for i in range(3000)] + [(i, f"own {i}", None, None, None) for i in range(100, 400)] + [(None, f"none {i}", None, None, None) for i in range(1200)]
    base = make(rows).select("doc_id", "text").withColumn("h_", F.xxhash64("text"))
    g, r = spotsigs.id_range(base, rows=50, segments=32)
    placed = base.withColumn("g", g).withColumn("r", r).collect()
    order = sorted(placed, key=lambda x: (x.doc_id is not None, x.doc_id or 0, x.h_))
    assert [(x.g, x.r) for x in order] == sorted((x.g, x.r) for x in placed)
    size = {}
    for x in placed:
        size[x.g, x.r] = size.get((x.g, x.r), 0) + 1
    assert max(size.values()) < 300
    out = spotsigs.fingerprint(make(rows), spark).collect()
    got = {(x.doc_id, x.edited_sha256) for x in out}
    for k, x in enumerate(order):
        half = len(x.text) // 2
        edited = x.text[: len(x.text) - half] + order[k - 1].text[:half]
        assert (x.doc_id, hashlib.sha256(edited.encode()).hexdigest()) in got
    assert len(out) == len(rows)


def test_query_against_plain(spark, make):
    rows = [(3 * i, prose(i, 30 + 9 * i), "en", "s", 1) for i in range(30)] + [(1000, None, None, None, None), (1001, "", "en", "s", 1), (1002, "😀é word", "en", "s", 1), (-7, prose(2, 48), "en", "s", 1), (10**15, "far away", "en", "s", 1), (1003, "z" * 3000, "en", "s", 1)]
    got = {r.doc_id: r for r in spotsigs.fingerprint(make(rows), spark).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + (after[1] or "")[:half]
        g = got[r[0]]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, n = (set(x.split()) for x in (g.fingerprint, g.edited_fingerprint, got[after[0]].fingerprint))
        like = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        assert abs(g.near_edited - like(a, b)) < 1e-12 and abs(g.near_next - like(a, n)) < 1e-12
        assert bool(a) == bool(text.strip())
    assert got[6].fingerprint != got[9].fingerprint and got[1000].fingerprint == got[1001].fingerprint == ""


def test_odd_rows(spark, odd, none):
    out = spotsigs.fingerprint(odd, spark).collect()
    assert len(out) == odd.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert len({r.fingerprint for r in out if r.doc_id == 0}) == 1
    assert spotsigs.fingerprint(none, spark).count() == 0
    assert spotsigs.fingerprint(odd.where("doc_id = 5"), spark).count() == 1


def test_near_pairs(spark):
    sets = {i: sorted({(j * 7919) % 1000 for j in range(i, i + 40 + i % 5)}) for i in range(60)} | {100: [], 101: [5], 102: [5], 103: sorted({(j * 7919) % 1000 for j in range(3, 44)})}
    got = {(r.a, r.b): r.likeness for r in spotsigs.near_pairs(spark.createDataFrame(list(sets.items()), "doc_id long, sigs array<int>"), spark).collect()}
    names = {}
    for i, s in sorted(sets.items()):
        names.setdefault(tuple(s), i)
    want = {}
    for s, a in names.items():
        for t, b in names.items():
            if a < b and s and t and len({*s} & {*t}) / len({*s} | {*t}) >= 0.8:
                want[a, b] = len({*s} & {*t}) / len({*s} | {*t})
    assert got == want and len(want) > 20


def test_signatures_follow_anchors(spark):
    df = spark.createDataFrame([("The quick brown fox of amber. The quick brown fox of amber.",), ("the quick brown fox",), ("fox the quick brown",)], "t string")
    sizes = [len(r.s) for r in spotsigs.with_signatures(df, "t", "s").select(F.col("s")).collect()]
    assert sizes[0] >= 3 and sizes[1] >= 1
