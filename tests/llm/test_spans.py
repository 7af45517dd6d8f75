import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from strataframe.llm import spans
from tests.llm.conftest import prose


def plain_parts(text):
    """Sentences of a text, and sentences and pieces, as words with the white space around them, by the rules as the operator's docstring has them."""
    text, sentences, at = text or "", [], 0
    for end in [*(m.end() for m in re.finditer(r"[.!?]+\s+|\n\s*", text)), len(text)]:
        if text[at:end].strip():
            sentences.append(text[at:end])
            at = end
        elif sentences:
            sentences[-1] += text[at:end]
            at = end
    units = []
    for s in sentences:
        words = re.findall(r"\s*\S+\s*", s)
        cuts = plain_cuts([xxhash.xxh3_64_intdigest(w.strip().lower().encode()) for w in words]) if len(words) > spans.PIECE_WORDS else []
        units += ["".join(words[a:b]) for a, b in zip([0, *cuts], [*cuts, len(words)])]
    return sentences, units


def plain_cuts(h):
    """Numbers of words before each piece end but the last: least of ``NEAR`` on either side, then of fewer inside what is still too long."""
    pieces = [(0, len(h))]
    for near in range(spans.NEAR, -1, -1):
        new = []
        for a, b in pieces:
            if b - a <= spans.PIECE_WORDS:
                new.append((a, b))
                continue
            if near:
                # earlier words must be greater, later ones not less
                cut = [i + 1 for i in range(a + near, b - near - 1) if all(h[j] > h[i] for j in range(i - near, i)) and all(h[j] >= h[i] for j in range(i + 1, i + near + 1))]
            else:
                cut = sorted({max(i for i in range(j, j + spans.WINDOW) if h[i] == min(h[j : j + spans.WINDOW])) + 1 for j in range(a, b - spans.WINDOW + 1)} - {b})
            new += list(zip([a, *cut], [*cut, b]))
        pieces = new
    return [b for _, b in pieces[:-1]]


def plain_runs(text):
    """(begin, end) in words and the words of every hashed run, by trying every end."""
    words, found = (text or "").lower().split(), {}
    for parts in plain_parts(text):
        edge = [0]
        for p in parts:
            edge.append(edge[-1] + len(p.split()))
        ok = lambda p, q: q - p >= spans.RUN and edge[q] - edge[p] >= spans.LEAST_WORDS  # noqa: E731, B023
        n = len(parts)
        for p in range(n):
            end = next((q for q in range(p, n + 1) if ok(p, q)), None)
            if end:
                found[edge[p], edge[end]] = None
        if parts is not None and parts == plain_parts(text)[0]:
            last = next((p for p in range(n, -1, -1) if ok(p, n)), None)
            if last is not None:
                found[edge[last], edge[n]] = None
    return [(a, b, tuple(words[a:b])) for a, b in found]


def slow(rows):
    """Kept text of each row (id, text), as a list of (id, text before, kept): every repeated run compared word by word; of equal rows the first is the one that counts."""
    def key(i, t):
        h = xxhash.xxh64_intdigest((t or "").encode(), 42)
        return ((1 << 62) + (h >> 3) if i is None else i, np.uint64(h).astype(np.int64))

    first, out, done = {}, [], set()
    order = sorted(set(rows), key=lambda r: key(*r))
    for i, t in order:
        for a, _, words in plain_runs(t):
            first.setdefault(words, (i, t, a))
    for i, t in rows:
        gone = {k for a, b, words in plain_runs(t) if (i, t) in done or first[words] != (i, t, a) for k in range(a, b)}
        done.add((i, t))
        spaced = re.findall(r"\S+\s*", t or "")
        lead = (t or "")[: len(t or "") - len("".join(spaced))]
        spaced[:1] = [lead + w for w in spaced[:1]]
        out.append((i, t, "".join(w for k, w in enumerate(spaced) if k not in gone).rstrip() if gone else t))
    return out


def test_layout():
    for t in ["", None, "   ", "a. b! c?\n\nd", prose(1, 500), "x" * 1000, "\n\n lead. in \n", "w " * 333, "Z.\n" * 40, "no end", "one. two. " * 9 + "tail of it"]:
        layout = spans.Layout(t)
        sentences, units = plain_parts(t)
        edges = lambda parts: [sum(len(p.split()) for p in parts[:k]) for k in range(len(parts) + 1)] if parts else []
        assert layout.sentences.tolist() == edges(sentences) and layout.units.tolist() == edges(units)
        found, hashes = layout.runs()
        assert sorted(map(tuple, found.tolist())) == sorted((a, b) for a, b, _ in plain_runs(t)) and len(found) == len(hashes)
        kept, n = layout.without(np.zeros(len(layout.ends), bool))
        assert kept == (t or "").rstrip() and n == 0


def test_hashes_differ_where_words_do():
    r = random.Random(1)
    seen = {}
    for _ in range(400):
        words = [r.choice(["a", "b", "c", "d"]) for _ in range(60)]
        text = "".join(w + r.choice([" ", ". ", "\n", "  "]) for w in words)
        layout = spans.Layout(text)
        low = [w.rstrip(".") for w in text.split()]
        for (a, b), h in zip(*layout.runs(), strict=True):
            assert seen.setdefault(tuple(text.lower().split()[a:b]), tuple(h)) == tuple(h)
        assert len(low) == 60
    assert len(set(seen.values())) == len(seen) > 2000


def test_against_brute_force(spark, make):
    passage = prose(77, 70)
    rows = [(i, prose(i, 80) + " " + (passage + " " if i % 3 == 0 else "") + prose(i + 500, 40), "en", "s", 9) for i in range(30)] + [(50, prose(4, 80), "en", "s", 1), (51, passage + " " + passage, "en", "s", 1), (52, None, None, None, None), (53, "", "en", "s", 0)]
    got = {r.doc_id: r for r in spans.dedup(make(rows), spark).collect()}
    assert [(i, t, got[i].text) for i, t, *_ in rows] == slow([(r[0], r[1]) for r in rows])
    assert passage in got[0].text and all(passage not in got[i].text for i in range(3, 30, 3))
    assert all(got[i].n_chars == len(got[i].text) for i in range(30))
    assert got[1].text == rows[1][1] and got[52].text is None


def test_copies_with_null_and_repeated_ids(spark, make):
    """Of equal rows one keeps its text, and a passage stays in the first of the rows that share an id."""
    text, passage = prose(31, 90), prose(32, 60)
    rows = [(None, text)] * 4 + [(7, passage + " " + prose(33, 40)), (7, prose(34, 40) + " " + passage), (7, passage + " " + prose(33, 40)), (None, prose(35, 30) + " " + passage), (None, None), (None, None), (8, "two words"), (8, "two words")]
    got = spans.dedup(make([(i, t, "en", "s", 1) for i, t in rows]).coalesce(1), spark).collect()
    want = slow(rows)
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(k)) for i, _, k in want)
    assert sorted(r.text for r in got if r.doc_id is None and r.text is not None)[:3] == ["", "", ""] and sum(text == r.text for r in got) == 1
    assert sum(passage in (r.text or "") for r in got) == 1 and sum(r.text == "two words" for r in got) == 2


def test_whole_copies_keep_nothing(spark, make):
    """Short sentences at the end too."""
    texts = [prose(40 + i, 50) + " Yes." * (i % 4) + " The end is near. So it is." for i in range(12)] + ["One two. " * 10, "a b c d e\n" * 3]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(100 + i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in spans.dedup(make(rows), spark).collect()}
    assert all(got[100 + i] == "" for i in range(len(texts)))


def test_odd_rows(spark, odd, none):
    out = spans.dedup(odd, spark)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert sorted(bool(r.text) for r in out.where("doc_id = 0").collect()) == [False, False, True]
    assert spans.dedup(none, spark).count() == 0
    assert all(r.score == "own" for r in out.collect())


def test_working_names_and_odd_names(spark, make):
    """Columns named as the operator's own, and names with blanks and dots, pass through."""
    passage = prose(5, 60)
    df = make([(1, passage, "en", "s", 1), (2, passage + " " + prose(6, 30), "en", "s", 1)])
    more = {"k_": 1, "t_": "x", "places_": 2.5, "K__": 3, "two words": 4, "a.b": 5, "n_removed": 7}
    for c, v in more.items():
        df = df.withColumn(c, F.lit(v))
    got = {r.doc_id: r.asDict() for r in spans.dedup(df, spark).collect()}
    assert all(got[2][c] == v for c, v in more.items() if c != "n_removed") and got[2]["n_removed"] > 0
    assert passage not in got[2]["text"] and got[1]["text"] == passage


def shared(a, b, least=51):
    """Longest stretches of words, ``least`` or more, that stand in both texts, by brute force: (start in a, length)."""
    a, b, out, i = a.lower().split(), b.lower().split(), [], 0
    while i < len(a):
        n = max((next(k for k in range(len(a) + 1) if i + k >= len(a) or j + k >= len(b) or a[i + k] != b[j + k]) for j in range(len(b)) if b[j] == a[i]), default=0)
        if n >= least:
            out.append((i, n))
        i += max(n, 1) if n >= least else 1
    return out


def test_every_shared_stretch_of_51_words_is_cut(spark, make):
    r = random.Random(11)

    def some(n, low, high, end):
        out = []
        while len(out) < n:
            k = min(n - len(out), r.randint(low, high))
            out += [f"w{r.randrange(4000)}" for _ in range(k)]
            out[-1] += end
        return " ".join(out)

    passages = [some(51, 1, 1, "\n"), some(60, 1, 3, "\n"), some(155, 1, 1, "\n"), "w " * 51, "one two\n" * 30, some(51, 20, 40, ".")] + [some(51, 200, 200, "") for _ in range(40)] + [some(51, 1, 30, ".") for _ in range(20)]
    rows = []
    for k, p in enumerate(passages):
        for copy in (0, 1):  # begins and ends inside sentences that differ
            rows.append((2 * k + copy, some(r.randint(0, 60), 90, 90, "") + " " + p + " " + some(r.randint(0, 60), 90, 90, ""), "en", "s", 1))
    got = {x.doc_id: x.text for x in spans.dedup(make(rows), spark).collect()}
    for k in range(len(passages)):
        before, text, after = rows[2 * k][1], rows[2 * k + 1][1], got[2 * k + 1]
        assert shared(text, before) and len(text.split()) - len(after.split()) >= 15, k
        assert not shared(after, before), k


def test_runs_grow_to_the_least_words():
    assert spans.reach(list(range(21))).tolist() == [[i, i + 15] for i in range(6)]
    assert spans.reach([0, 5, 10, 15, 35]).tolist() == [[0, 15], [5, 35]] and spans.reach([0, 20, 40]).tolist() == []
    assert len(spans.Layout("word\n" * 20).runs()[0]) == 6
