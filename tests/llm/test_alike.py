import functools
import random

import corpus_pipeline
from strataframe.llm import alike, simhash
from tests.llm.test_simhash import slow_groups


def edited(seed, words, edits):
    r, words = random.Random(seed), list(words)
    for k in r.sample(range(len(words)), edits):
        words[k] = f"e{seed}x{k}"
    return " ".join(words)


@functools.cache
def grams(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def corpus():
    r = random.Random(3)
    rows = []
    for k in range(12):
        words = [f"w{r.randrange(3000)}" for _ in range(200)]
        rows += [(100 * k + i, edited(100 * k + i, words, i % 5), "en", "s", 1) for i in range(8)]
    hot = [f"h{i}" for i in range(200)]
    return rows + [(5000 + i, edited(i, hot, 2), "en", "s", 1) for i in range(150)]


def test_stage_joins_texts_of_similarity_080(spark, make):
    rows = corpus()
    texts = {i: t for i, t, *_ in rows}
    pairs = [(a, b) for a in texts for b in texts if a < b and abs(a - b) < 200 and jaccard(texts[a], texts[b]) >= 0.8]
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    assert sum((prints[a] ^ prints[b]).bit_count() > 3 for a, b in pairs) > len(pairs) / 2
    want = slow_groups(texts, [*pairs, *((a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= 3)])
    found = alike.links(make(rows).selectExpr("doc_id id", "text"), spark).collect()
    assert found and {(r.a, r.b) for r in found} <= set(pairs)
    got = corpus_pipeline.near_duplicate_stage(spark, make(rows), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(want.values()))


def test_rows_of_one_id_with_different_texts_stay(spark, make):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "en", "s", 1), (7, a, "en", "s", 1), (7, b, "en", "s", 1), (7, c, "en", "s", 1), (7, c, "en", "t", 1), (9, b, "en", "s", 1)]
    got = corpus_pipeline.near_duplicate_stage(spark, make(rows), "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, a), (7, b), (7, c)]
    again = corpus_pipeline.near_duplicate_stage(spark, make(rows[::-1]).repartition(3), "").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def template(texts, pairs, seed=1):
    """Texts on one template: all share 0.78 of their shingles, and ``pairs`` of them 0.83 with the next."""
    r = random.Random(seed)
    base = [f"t{i}" for i in range(400)]
    rows, near = [], []
    for k in range(texts):
        words = list(base)
        at = [5 * j for j in r.sample(range(1, 79), 10)]
        if k % 2 and k // 2 < pairs:  # all edits of the one before but two
            words, at = rows[-1][1].split(), at[:2]
            for j in r.sample([i for i, w in enumerate(words) if w.startswith("e")], 2):
                words[j] = base[j]
            near.append((k - 1, k))
        for j in at:
            words[j] = f"e{k}x{j}"
        rows.append((k, " ".join(words)))
    return rows, near


def test_one_template_and_pairs_closer_than_it(spark, make):
    """Every pair of the corpus meets in large buckets, next to none is alike enough, and all that are come back."""
    rows, near = template(300, 120)
    texts = dict(rows)
    want = {(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.8}
    assert len(want) >= 100 and sum(jaccard(texts[0], texts[b]) >= 0.8 for b in range(2, 300)) == 0
    found = {(r.a, r.b) for r in alike.links(make(rows, "id long, text string"), spark).collect()}
    assert found <= want and len(found) >= 0.99 * len(want)


def test_rare_candidates_hold_every_pair(spark, make):
    rows = [(i, t) for i, t, *_ in corpus()][::3] + [(9000 + i, t) for i, t in template(60, 20)[0]]
    texts = make(rows, "id long, text string")
    named = dict(rows)
    for least in (0.6, 0.8):
        open_ = texts.selectExpr("id", "id p")
        found = {(min(r.a, r.b), max(r.a, r.b)) for r in alike.rare_candidates(open_, texts, spark, least, 5).collect()}
        assert {(a, b) for a in named for b in named if a < b and jaccard(named[a], named[b]) >= least} <= found
        same = alike.rare_candidates(texts.selectExpr("id", "id div 9000 p"), texts, spark, least, 5)
        assert same.where("a div 9000 = b div 9000").count() == 0


def test_few_words_and_no_texts(spark, make):
    rows = [(1, "one two"), (2, "One  TWO"), (3, ""), (4, None), (None, "one two"), (5, " ".join(f"q{i}" for i in range(9000)))]
    assert {(r.a, r.b) for r in alike.links(make(rows, "id long, text string"), spark).collect()} == {(1, 2)}
    assert alike.links(make([], "id long, text string"), spark).count() == 0
