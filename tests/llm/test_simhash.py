import random
import re

import xxhash

from strataframe.llm import simhash
from strataframe.llm.components import connected_components
from tests.llm.conftest import prose


def slow_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_against_brute_force(spark, odd, make):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    near = [(1000 + i, " ".join(w for k, w in enumerate(prose(50, 400).split()) if k != 7 * i), "en", "s", 1) for i in range(12)]
    got = simhash.near_duplicates(odd.select("doc_id", "text").unionByName(make(near).select("doc_id", "text")), spark).collect()
    rows += [(r[0], r[1]) for r in near]
    prints = {slow_print(t) for _, t in rows}
    group = slow_groups(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3])
    name = {}
    for i, t in rows:
        g = group[slow_print(t)]
        if i is not None:
            name[g] = min(i, name.get(g, i))
    want = sorted((str(i), f"{slow_print(t):016x}", str(name.get(group[slow_print(t)]))) for i, t in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert len({r.component_id for r in got if r.doc_id is not None and r.doc_id >= 1000}) < 12


def test_links_of_close_prints(spark):
    r = random.Random(4)
    base = [r.getrandbits(63) for _ in range(40)]
    prints = set(base) | {b ^ sum(1 << k for k in r.sample(range(63), n)) for b in base for n in (1, 2, 3, 4)}
    got = {(x.a, x.b) for x in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    assert got == {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)] + [(7, 7), (3, 2)]
    got = {x.id: x.component_id for x in connected_components(spark.createDataFrame([*edges, (None, 3)], "u long, v long"), spark).collect()}
    want = slow_groups({n for e in edges if e[0] != e[1] for n in e}, [e for e in edges])
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long"), spark).count() == 0


def test_no_rows(spark, none):
    assert simhash.near_duplicates(none, spark).count() == 0
