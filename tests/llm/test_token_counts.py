import random

import pytest
from pyspark.sql import functions as F

from strataframe.llm import token_counts as tc

PARTS = ["the ", "hello", "'re", "'ll ", "é", "é", " ", "\n", "<|endoftext|>", "<|STARTOFTEXT|>", "<|endo", "international", "x'", "!!", "İ", " ", "ΣΑΣ ", "日本", "1234", "́", "😀", "ԱԲ", "՘"]


@pytest.fixture(scope="module")
def vocabulary():
    return tc.Vocabulary(tc.file_bytes())


@pytest.fixture(scope="module")
def plain(vocabulary):
    return lambda text: len(vocabulary.library.encode(text or "", add_special_tokens=False).ids)


def test_random_words(vocabulary, plain):
    r = random.Random(5)
    for signs in ("ab", "abcde", "etaoinshrdlu", "xyz'", "thein", "éàüñßø", "a1!'sr ", "日本語の", "😀👍é", "aaab"):
        for _ in range(500):
            s = "".join(r.choice(signs) for _ in range(r.randint(1, 18)))
            assert vocabulary.count(s) == plain(s), s


def test_every_prefix_and_budget(vocabulary, plain):
    r = random.Random(6)
    for _ in range(300):
        s = "".join(r.choice(PARTS) for _ in range(r.randint(0, 8)))
        want = [plain(s[:i]) for i in range(len(s) + 1)]
        assert vocabulary.text_table(s).tolist() == want, s
        for limit in (0, 1, 3, 7):
            assert vocabulary.fit(s, limit) == max(i for i, n in enumerate(want) if n <= limit), (s, limit)


def test_characters_taken_for_plain_are_alike(vocabulary):
    lib = vocabulary.library
    for i in range(0x110000):
        c = chr(i) if not 0xD800 <= i <= 0xDFFF else ""
        if c and tc._PLAIN.fullmatch(c):
            assert lib.normalizer.normalize_str(c) == tc.regex.sub(r"\s", " ", vocabulary.normal(c)), hex(i)
            assert len(lib.pre_tokenizer.pre_tokenize_str(f"a{c}{c}1")) == len(vocabulary.split.findall(f"a{c}{c}1")), hex(i)


def test_same_as_library(spark, odd, plain):
    rows = tc.token_counts(odd, spark, limit=60).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), plain(r.text), plain(r.text) > 60) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert any(r.over_limit for r in rows) and any(r.n_tokens == 0 for r in rows)


def test_questions_by_the_table(spark, odd, plain):
    short = odd.where("length(coalesce(text, '')) < 700")
    counted = tc.prefix_counts(short, spark)
    texts = {str(r.doc_id): r.text or "" for r in short.collect()}
    asked = counted.select("doc_id", "counts", tc.tokens_at("counts", F.lit(25)).alias("at"), tc.fits("counts", 9).alias("fit"), tc.fits("counts", -1).alias("none"))
    for r in asked.collect():
        text = texts[str(r.doc_id)] if r.doc_id is not None else None
        if text is not None:
            assert r["counts"] == [plain(text[:i]) for i in range(len(text) + 1)]
            assert r["at"] == plain(text[:25]) and r["none"] is None
            assert r["fit"] == max(i for i in range(len(text) + 1) if plain(text[:i]) <= 9)
    for r in tc.truncated(short, spark, 9).collect():
        assert r.n_tokens == plain(r.text) <= 9
        if r.doc_id is not None:
            assert texts[str(r.doc_id)].startswith(r.text)


def test_no_rows_and_no_budget(spark, none, odd):
    assert tc.token_counts(none, spark).count() == 0 and tc.prefix_counts(none, spark).count() == 0
    assert tc.token_counts(none, spark).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"]
    with pytest.raises(ValueError):
        tc.truncated(odd, spark, -1)
    with pytest.raises(ValueError):
        tc.token_counts(odd, spark, limit=-1)
