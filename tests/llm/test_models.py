import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from strataframe.llm import quality, toxicity
from tests.llm.conftest import prose

LABELS = "doc_id long, quality int, toxic int"
INSULTS = ["idiot", "moron", "stupid", "scum"]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def corpus(make):
    r = random.Random(1)
    docs, labels = [], []
    for i in range(400):
        text, bad, rude = prose(i, r.randint(30, 120)), i % 7 == 0, i % 4 == 0
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split()[:10]) * 6
        if rude:
            words = text.split()
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(INSULTS))
            text = " ".join(words)
        docs.append((i, text, "en", "s", 1))
        labels.append((i, int(not bad), int(rude)))
    return make(docs), make(labels, LABELS)


def right(spark, out, labels, column):
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    return sum(r.predicted == r[column] for r in rows) / len(rows)


def test_toxicity(spark, corpus, odd, none):
    docs, labels = corpus
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, spark, model)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.collect())
    assert right(spark, out, labels, "toxic") >= 0.95
    plain, spelt, gap = (model.scores([prose(5, 40) + f" {w}. " + prose(6, 40)] , {})[0] for w in ("idiot", "i d i o t", "idxiot"))
    clean = model.scores([prose(5, 40) + " " + prose(6, 40)], {})[0]
    assert min(plain, spelt, gap) > clean and plain > 0.5
    assert toxicity.score(odd, spark, model).count() == odd.count()
    assert toxicity.score(none, spark, model).count() == 0


def test_toxicity_without_labels(spark, corpus, make):
    docs, labels = corpus
    assert {r.score for r in toxicity.score(docs, spark, toxicity.train(docs, labels.where("false"))).collect()} == {0.5}
    assert {r.score for r in toxicity.score(docs, spark, toxicity.train(docs, labels.where("toxic = 1"))).collect()} == {1.0}
    toxicity.train(docs, make([(None, None, None), (1, 1, None), (3, None, 1), (3, None, 1)], LABELS))


def test_held_out_labels_are_not_read(corpus, make):
    docs, labels = corpus
    flipped = make([(r.doc_id, r.quality, 1 - r.toxic if held(r.doc_id) else r.toxic) for r in labels.collect()], LABELS)
    texts = ["one idiot here", "a calm river"]
    assert toxicity.train(docs, labels).scores(texts, {}).tolist() == toxicity.train(docs, flipped).scores(texts, {}).tolist()


def test_quality(spark, corpus, odd, none):
    docs, labels = corpus
    model = quality.train(docs, labels, spark)
    assert 0 < len(model.rules) < 100
    out = quality.score(docs, model).withColumn("held_out", quality.held_out())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.collect())
    assert right(spark, out, labels, "quality") >= 0.95
    scored = quality.score(odd, model)
    assert scored.count() == odd.count() and set(scored.columns) == set(odd.columns)
    assert quality.keep(odd, model).columns == odd.columns and all(r.score == "own" for r in quality.keep(odd, model).collect())
    assert quality.score(none, model).count() == 0


def plain_statistics(text):
    """The statistics by Python's own means."""
    text = text or ""
    words, lines = re.findall(r"[^ \t\n\x0b\f\r]+", text), text.split("\n")
    n = len(words)
    per = lambda k: k / n if n else 0.0
    return {
        "log_words": math.log1p(n), "distinct": per(len(set(words))), "word_length": per(len(text)), "common": per(sum(w.lower() in quality.COMMON for w in words)), "upper": per(sum(c.isupper() for c in text)),
        "symbols": per(sum(c in "#$%&*|~^<>{}[]=_+@\\/" for c in text)), "exclaim": per(text.count("!")), "stops": per(sum(c in ".?" and (i + 1 == len(text) or text[i + 1] in " \t\n\x0b\f\r") for i, c in enumerate(text))),
        "digits": per(sum(c in "0123456789" for c in text)), "lines_distinct": len(set(lines)) / len(lines), "lines_per_word": per(len(lines)),
    }


def test_quality_against_plain_rules(spark, corpus, odd):
    """Every score is that of the rules, tried one by one in Python on statistics counted in Python."""
    docs, labels = corpus
    model = quality.train(docs, labels, spark)
    for df in (docs, odd):
        for r in quality.score(df, model).collect():
            s = plain_statistics(r.text)
            margin = model.constant + sum(w for rule, w in model.rules if all((s[n] <= b) == at_most for n, at_most, b in rule))
            assert r.score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9), r.text


def test_quality_leaves_columns_alone(spark, corpus):
    docs, labels = corpus
    model = quality.train(docs, labels, spark)
    named = docs.withColumns({c: F.lit("own") for c in ("q_", "Q_score", "q_keep", "q_words_", "q_words", "q_lines", "two words", "q_log_words")})
    kept = quality.keep(named, model)
    assert kept.columns == named.columns and {r["q_words"] + r["Q_score"] + r["two words"] for r in kept.collect()} == {"ownownown"}
    assert set(quality.score(named, model).columns) == {*named.columns, "score", "predicted"}


def plain_kernel(a, b):
    """Sum over the subsequences of four characters that both words hold, decay to the span in each, normalised as documented; by direct enumeration."""

    def image(w):
        w, out = f"^{w}$", {}
        for at in itertools.combinations(range(len(w)), 4):
            if at[-1] - at[0] < toxicity.SPAN:
                key = "".join(w[i] for i in at)
                out[key] = out.get(key, 0.0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        spans = sum(toxicity.DECAY ** (2 * (at[-1] - at[0] + 1)) for at in itertools.combinations(range(len(w)), 4) if at[-1] - at[0] < toxicity.SPAN)
        return out, math.sqrt(spans + 1e-12)

    (x, nx), (y, ny) = image(a), image(b)
    return sum(v * y.get(k, 0.0) for k, v in x.items()) / nx / ny


def test_kernel_against_enumeration():
    landmarks = ["idiot", "moron", "river", "a", "été"]
    kernel = toxicity.Kernel(landmarks)
    words = ["idiot", "idxiot", "i-d-i-o-t", "riverside", "", "ab", "aaaa", "étéaa", "日本語学校"]
    got = kernel(words)
    for i, w in enumerate(words):
        for j, m in enumerate(landmarks):
            # a character that no landmark has matches none of theirs
            assert got[i, j] == pytest.approx(plain_kernel(w, m), abs=1e-9), (w, m)


def test_scores_against_a_loop(spark, corpus, odd):
    """Scores of whole texts are those of a plain sum over words and sentences, each word's margin from the landmarks' kernel values."""
    docs, labels = corpus
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, spark, model).collect()}
    word = lambda w: float(model.kernel.sums([w], model.line)[0])
    for r in docs.limit(25).collect():
        parts = toxicity.sentences(r.text)
        margins, tops = [sum(map(word, ws)) for ws in parts], sorted((max(map(word, ws), default=0.0) for ws in parts), reverse=True)
        n = sum(map(len, parts))
        f = [max(margins), tops[0], sum(tops[:5]) / min(5, len(tops)), sum(margins) / (1 + n), math.log1p(n), 1.0]
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(f, model.scale, strict=True)))), abs=1e-9)


def test_quality_without_labels(spark, corpus):
    docs, labels = corpus
    assert {round(r.score, 6) for r in quality.score(docs, quality.train(docs, labels.where("false"), spark)).collect()} == {0.5}
    assert min(r.score for r in quality.score(docs, quality.train(docs, labels.where("quality = 1"), spark)).collect()) > 0.9
