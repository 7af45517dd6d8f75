import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.llm import fim


def plain(doc_id, text, seed=7, percent=100, spm_percent=50):
    """The same by code points and a regular expression."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm_percent else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def lined(make):
    r = random.Random(3)
    pieces = ["a", "\n", "\n\n", "é", "日本", "😀", "<", "<P", "S>", "<<M", " word", "\r\n", "</P>", " "]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randint(0, 40)))) for i in range(400)]
    rows += [(500, "x<P>y"), (501, "<S>"), (502, "<M"), (503, ">P<"), (504, "\n"), (505, "\n" * 3000), (506, "z" * 9000 + "<" + "P>"), (507, "ab\n" * 4000), (508, None), (None, "one\ntwo"), (None, None), (507, "ab\n" * 4000)]
    return make(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("n", "form", "output", "prefix_chars")})


@pytest.mark.parametrize("given", [{}, {"seed": 11, "percent": 40, "spm_percent": 90}])
def test_same_as_plain(spark, odd, lined, given):
    for docs in (odd, lined):
        made = fim.transform(docs, **given).withColumn("back", fim.restored()).collect()
        got = sorted(str((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back)) for r in made)
        assert got == sorted(str((r.doc_id, *plain(r.doc_id, r.text, **given), r.text or "")) for r in docs.collect())
        assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_lanes_say_the_same_as_one_walk(monkeypatch):
    s, r = fim.Scanner(), random.Random(4)
    data = b"\xff".join("".join(r.choice(["<", "P", "<P>", ">", "\n", "é", "日", "😀", "a", "<S", "M>"]) for _ in range(r.randint(0, 60))).encode() for _ in range(300)) + b"\xff"
    state, want = s.begin * 256, []
    for b in data:
        want.append(s.says[state + b])
        state = s.goes[state + b]
    for lane in (8, 64, 1024):
        monkeypatch.setattr(fim, "LANE", lane)
        assert s.scan(np.frombuffer(data, np.uint8)).tolist() == want


def test_other_sentinels_and_none(none, make):
    marks = ("[[PRE]]", "[[SUF]]", "[MID]")
    docs = make([(1, "a\nb\nc[[[MID]]d"), (2, "a\n[[PRE]\nb[[SUF]\n"), (3, "[[[SUF]]")], "doc_id long, text string")
    rows = {r.doc_id: r for r in fim.transform(docs, sentinels=marks).withColumn("back", fim.restored(sentinels=marks)).collect()}
    assert rows[1].form == "plain" and rows[3].form == "plain" and rows[2].form != "plain" and rows[2].back == "a\n[[PRE]\nb[[SUF]\n"
    assert fim.transform(none).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<<S>", "<S>", "<M>"), ("é", "<S>", "<M>"), ("", "<S>", "<M>"), ("a\n", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.transform(docs, sentinels=bad)
