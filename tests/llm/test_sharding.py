import zlib
from collections import Counter

import xxhash

from strataframe.llm import sharding
from tests.llm.conftest import prose


def check(docs, out, shards):
    rows = out.collect()
    assert len(rows) == docs.count()
    count = Counter(r.shard for r in rows)
    assert max(count.values()) - min(count.get(s, 0) for s in range(shards)) <= 1
    for s in count:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))
    for source in {r.source for r in rows}:
        each = Counter(r.shard for r in rows if r.source == source)
        assert max(each.get(s, 0) for s in range(shards)) - min(each.get(s, 0) for s in range(shards)) <= 4
    text = {str(r.doc_id): (r.text or "").encode() for r in docs.collect() if r.doc_id is not None}
    assert all((len(text[str(r.doc_id)]) + 16, zlib.crc32(text[str(r.doc_id)])) == (r.size, r.text_crc32) for r in rows if r.doc_id is not None)
    assert {r.law for r in rows} == {"rows"} and all(r.grown_shard is None and 0 <= r.shard < shards for r in rows)


def test_laws(spark, odd, none, make):
    check(odd, sharding.shard(odd, spark, shards=4), 4)
    docs = make([(i, f"t{i}", "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(2003)])
    out = sharding.shard(docs, spark)
    check(docs, out, 40)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, sharding.shard(docs.repartition(5), spark).collect()), key=str)
    assert sharding.shard(none, spark).count() == 0
    check(docs.limit(3), sharding.shard(docs.limit(3), spark), 40)


def plain_places(rows, shards):
    """{(doc_id, text, source): [(shard, slot)]} by sorting everything in one list: the method as its docstring has it."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def chain(*parts):
        h = 42
        for p in parts:
            if p is not None:
                h = xxhash.xxh64_intdigest(p, h)
        return h

    number = lambda x, n: int(x).to_bytes(n, "little", signed=True)
    seed, full = number(sharding.SEED, 4), []
    for i, t, s in rows:
        b = (t or "").encode()
        k = chain(seed, None if i is None else str(i).encode(), number(zlib.crc32(b), 8), number(len(b) + 16, 8))
        full.append(((i is not None, i or 0, zlib.crc32(b), len(b) + 16), signed(k), k >> 52, (i, t, s)))
    placed = []
    for source in {r[2] for r in rows}:
        mine = sorted((f for f in full if f[3][2] == source), key=lambda f: (f[2], signed(f[1] << 12 & (1 << 64) - 1), f[1], f[0]))
        phase = signed(chain(seed, None if source is None else source.encode())) % (1 << 20) / float(1 << 20)
        placed += [((r + phase) / len(mine), f[1], (source is None, source or ""), f[0], f[3]) for r, f in enumerate(mine)]
    out = {}
    for place, f in enumerate(sorted(placed, key=lambda f: f[:4])):
        shard = place * shards // len(placed)
        out.setdefault(f[4], []).append((shard, place - (shard * len(placed) + shards - 1) // shards))
    return out


def test_every_place_against_one_sort(spark, make):
    rows = [(i, prose(i % 40, 3 + i % 50), "hot" if i % 3 else f"s{i % 5}") for i in range(700)] + [(9000 + i, "copy", "hot") for i in range(120)] + [(None, "none", None), (None, None, "s1"), (-3, "", None)]
    got = {}
    for r in sharding.shard(make([(i, t, None, s, 1) for i, t, s in rows]), spark, shards=7).collect():
        got.setdefault((r.doc_id, r.text_crc32, r.source), []).append((r.shard, r.slot))
    want = {}
    for (i, t, s), at in plain_places(rows, 7).items():
        want.setdefault((i, zlib.crc32((t or "").encode()), s), []).extend(at)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_groups_are_named_and_spread(spark, make):
    rows = sharding.shard(make([(i, "same" if i % 3 else f"t{i}", "en", "s", 1) for i in range(900)]), spark, shards=10).collect()
    group = [r for r in rows if r.doc_id % 3]
    assert len({r.text_group for r in group}) == 1 and len({r.text_group for r in rows}) == 301
    assert {r.shard for r in group} == set(range(10))
