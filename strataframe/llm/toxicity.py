"""Operator 5: toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two words sums, over the four-character subsequences that both hold, decay ** (span in each); so an insult with a
gap or inserted characters stays close to the plain one. A sentence is the sum of its words' images. Words are
mapped to the kernel's values at a few hundred landmark words, whitened (Nyström), and a linear squared-hinge SVM is trained on
sentences that carry their document's label; each further round keeps, of a toxic document, the sentences that the last
one scored highest. Platt scaling turns a document's highest and mean sentence margins into a score.

Training takes a bounded, seeded sample of labelled documents (``sample`` a class); scoring reads every whole text. A sentence's
margin is linear in its words, so a worker computes each distinct word once and keeps the number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.llm.shared import held_out, table

#: Labelled documents of each class that training may use.
SAMPLE = 1500
#: Bytes of their texts that training may use, of each class.
SAMPLE_BYTES = 32 << 20
#: Landmark words: those most enriched in toxic documents, and frequent ones as background.
LANDMARKS = (144, 48)
#: Sentences of toxic and of other documents that the machine is trained on.
SENTENCES = 20_000
DECAY, SPAN = 0.7, 6
#: Words whose margins a worker keeps.
KEPT = 1_000_000
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_SPELT = re.compile(r"(?<!\S)(?:\w[^\w\s]? ){2,}\w(?!\w)")
_DOTTED = re.compile(r"(?:\w[\W_]){2,}\w$")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_OFFSETS = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]
#: Longer words are cut into overlapping pieces, so that no part of a text goes unread.
_PIECE, _STEP = 32, 24


def sentences(text: str | None) -> list[list[str]]:
    """Lower-cased words of each sentence; a word spelt out with spaces or marks is one plain word. Null and empty: one empty sentence."""
    text = (text or "").lower()
    if " " in text:
        text = _SPELT.sub(lambda m: m[0].replace(" ", ""), text)
    return [_words(s) for s in _SENTENCE.split(text)]


def _words(sentence: str) -> list[str]:
    out = []
    for w in sentence.split():
        w = _EDGE.sub("", w)
        if len(w) > 4 and _DOTTED.match(w):
            w = w[::2]
        if len(w) <= _PIECE:
            out.append(w)
        else:
            out += [w[i : i + _PIECE] for i in range(0, len(w) - (_PIECE - _STEP), _STEP)]
    return out


class Kernel:
    """Values, at the landmarks, of the subsequence kernel of order 4, normalised by word length.

    A word's image has a coordinate for each subsequence of four characters within ``SPAN`` places, word ends included, that weighs
    decay ** span; only coordinates that some landmark has can matter, and those are numbered here.
    """

    def __init__(self, landmarks: list[str]):
        self.letters = np.zeros(0x110000, np.uint8)
        alphabet = sorted({ord(c) for w in landmarks for c in w} | {ord("^"), ord("$")})[:255]
        self.letters[alphabet] = np.arange(1, len(alphabet) + 1)
        self.size = len(alphabet) + 1
        own, code, weight = self._entries(landmarks)
        self.codes, at = np.unique(code, return_inverse=True)
        self.table = np.zeros((len(self.codes), len(landmarks)))
        np.add.at(self.table, (at, own), weight)

    def _entries(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word number, subsequence, normalised weight) of all subsequences in the landmarks' letters."""
        text = "".join([f"^{w}$" for w in words])
        letter = self.letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        size = np.array([len(w) + 2 for w in words], np.int64)
        owner, place = np.repeat(np.arange(len(words)), size), np.arange(len(letter)) - np.repeat(np.cumsum(size) - size, size)
        room = size[owner] - place  # characters from here to the word's end
        norm = np.sqrt(sum(DECAY ** (2 * (o[-1] + 1)) * np.maximum(size - o[-1], 0) for o in _OFFSETS) + 1e-12)
        own, code, weight = [], [], []
        for o in _OFFSETS:
            i = np.flatnonzero((room > o[-1]) & (letter > 0))
            rest = [letter[i + k] for k in o]
            full = (rest[0] > 0) & (rest[1] > 0) & (rest[2] > 0)
            i = i[full]
            own.append(owner[i])
            code.append(((letter[i] * self.size + rest[0][full]) * self.size + rest[1][full]) * self.size + rest[2][full])
            weight.append(DECAY ** (o[-1] + 1) / norm[owner[i]])
        return np.concatenate(own), np.concatenate(code), np.concatenate(weight)

    def __call__(self, words: list[str]) -> np.ndarray:
        """A row a word, a column a landmark."""
        out = []
        for k in range(0, len(words), 1024):
            own, code, weight = self._entries(words[k : k + 1024])
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[at] == code
            n = len(words[k : k + 1024])
            out.append(np.bincount(own[hit] * len(self.codes) + at[hit], weight[hit], n * len(self.codes)).reshape(n, -1) @ self.table)
        return np.concatenate(out)

    def along(self, weight: np.ndarray) -> dict[str, np.ndarray]:
        """The landmark weights folded into the subsequences: a word's value is then one sum over its own."""
        return {"codes": self.codes, "value": self.table @ weight}

    def sums(self, words: list[str], line: dict[str, np.ndarray]) -> np.ndarray:
        own, code, weight = self._entries(words)
        at = np.minimum(np.searchsorted(line["codes"], code), len(line["codes"]) - 1)
        return np.bincount(own, np.where(line["codes"][at] == code, weight * line["value"][at], 0.0), len(words))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float) -> np.ndarray:
    """Weights of a linear squared-hinge SVM, bias last, by Newton steps; rows are summed some thousands at a time."""
    n = x.shape[1] + 1
    w, ridge = np.zeros(n), np.eye(n) / c
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        left, right = ridge.copy(), np.zeros(n)
        for k in range(0, len(x), 8192):
            some = np.c_[x[k : k + 8192].astype(np.float64), np.ones(len(x[k : k + 8192]))]
            active = y[k : k + 8192] * (some @ w) < 1
            some, wa, ya = some[active], weight[k : k + 8192][active], y[k : k + 8192][active]
            left += (some * wa[:, None]).T @ some
            right += some.T @ (wa * ya)
        new = np.linalg.solve(left, right)
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w


def _platt(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights over document features, bias last, by Newton steps with a small ridge."""
    f = np.c_[f, np.ones(len(f))]
    w = np.zeros(f.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        step = np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + 1e-2 * np.eye(len(w)), f.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """What scoring needs: landmarks' kernel, one weight a landmark, a bias, and the scaling. Some hundred KB."""

    def __init__(self, kernel: Kernel | None, weight: np.ndarray | None, bias: float, scale: np.ndarray, prior: float):
        self.kernel, self.bias, self.scale, self.prior = kernel, bias, scale, prior
        self.line = kernel.along(weight) if kernel else None

    def margins(self, words: list[str]) -> np.ndarray:
        return self.kernel.sums(words, self.line)

    def scores(self, texts: list[str | None], known: dict[str, float]) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(texts), self.prior)
        split = [sentences(t) for t in texts]
        new = list({w for s in split for ws in s for w in ws if w not in known})
        if len(known) + len(new) > KEPT:
            known.clear()
            new = list({w for s in split for ws in s for w in ws})
        for k in range(0, len(new), 20_000):
            known.update(zip(new[k : k + 20_000], self.margins(new[k : k + 20_000]).tolist(), strict=True))
        f = np.array([_features([sum(map(known.__getitem__, ws)) for ws in s], [max(map(known.__getitem__, ws), default=0.0) for ws in s], sum(map(len, s))) for s in split])
        return 1 / (1 + np.exp(-np.clip(np.c_[f, np.ones(len(f))] @ self.scale, -30, 30)))


def _features(margin: list[float], top: list[float], words: int) -> tuple:
    """Of a document: highest sentence and word, its strongest words' mean, mean per word, and length."""
    best = sorted(top, reverse=True)
    return max(margin), best[0], sum(best[:5]) / min(5, len(best)), sum(margin) / (1 + words), np.log1p(words)


class _Words:
    """A sample's texts as numbers: words end to end, where each sentence begins, and where each document's sentences begin."""

    def __init__(self, texts: list[str | None]):
        self.number: dict[str, int] = {}
        words, sentence, document = [], [0], [0]
        for t in texts:
            for ws in sentences(t):
                words.append(np.array([self.number.setdefault(w, len(self.number)) for w in ws], np.int32))
                sentence.append(sentence[-1] + len(ws))
            document.append(len(sentence) - 1)
        self.words = np.concatenate(words) if words else np.zeros(0, np.int32)
        self.sentence, self.document = np.array(sentence), np.array(document)
        self.vocabulary = list(self.number)

    def sums(self, value: np.ndarray) -> np.ndarray:
        """Sum of a word value over each sentence."""
        total = np.r_[0.0, np.cumsum(value[self.words])]
        return total[self.sentence[1:]] - total[self.sentence[:-1]]

    def images(self, chosen: np.ndarray, kernel: Kernel, whiten: np.ndarray) -> np.ndarray:
        """Summed images of the chosen sentences' words, by parts of the vocabulary."""
        size = self.sentence[chosen + 1] - self.sentence[chosen]
        row = np.repeat(np.arange(len(chosen)), size)
        at = self.words[np.repeat(self.sentence[chosen], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        used, first = np.unique(at, return_index=True)
        first = np.r_[first, len(at)]
        out = np.zeros((len(chosen), whiten.shape[1]), np.float32)
        for k in range(0, len(used), 1024):
            image = (kernel([self.vocabulary[i] for i in used[k : k + 1024]]) @ whiten).astype(np.float32)
            lo, hi = first[k], first[min(k + 1024, len(used))]
            np.add.at(out, row[lo:hi], image[np.searchsorted(used[k : k + 1024], at[lo:hi])])
        return out


def fit(rows: list[tuple[str | None, int]], rounds: int = 3, seed: int = 7) -> Model:
    """A model of (text, label 0 or 1) rows. With fewer than two labels it gives every text the label's share, without rows 0.5.

    ``SENTENCES`` of each kind at most are trained on.
    """
    y = np.array([t for _, t in rows], float)
    if len(set(y.tolist())) < 2:
        return Model(None, None, 0.0, np.zeros(6), float(y.mean()) if len(y) else 0.5)
    data = _Words([t for t, _ in rows])
    n, vocabulary = len(data.vocabulary), data.vocabulary
    of_sentence = np.repeat(np.arange(len(y)), np.diff(data.document))
    of_word = np.repeat(of_sentence, np.diff(data.sentence))
    pair = np.unique(of_word.astype(np.int64) * n + data.words)
    toxic = np.bincount(pair[y[pair // n] > 0] % n, minlength=n)
    clean = np.bincount(pair[y[pair // n] == 0] % n, minlength=n)
    nt, nc = y.sum(), (1 - y).sum()
    gain = np.where((toxic > 2) & (np.array([len(w) for w in vocabulary]) > 2), (toxic / nt - clean / nc) / np.sqrt(toxic + clean + 1.0), -np.inf)
    enriched = sorted(np.flatnonzero(gain > -np.inf).tolist(), key=lambda i: (-gain[i], vocabulary[i]))[: LANDMARKS[0]]
    frequent = sorted(np.argsort(-clean, kind="stable")[: 2 * sum(LANDMARKS)].tolist(), key=lambda i: (-clean[i], vocabulary[i]))
    chosen = [vocabulary[i] for i in enriched + [i for i in frequent if i not in set(enriched) and vocabulary[i]][: LANDMARKS[1]]]
    if not chosen:
        return Model(None, None, 0.0, np.zeros(6), float(y.mean()))
    kernel = Kernel(chosen)
    values, vectors = np.linalg.eigh(kernel(chosen))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    rng = np.random.default_rng(seed)
    label = y[of_sentence] > 0
    some = lambda i: np.sort(rng.permutation(i)[:SENTENCES])
    negative = some(np.flatnonzero(~label))
    positive = some(np.flatnonzero(label))
    x_negative = data.images(negative, kernel, whiten)
    for r in range(rounds):
        x = np.concatenate([data.images(positive, kernel, whiten), x_negative])
        side = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        w = _svm(x, side, np.where(side > 0, 1.0, 3.0 * len(positive) / max(1, len(negative))), c=1.0)
        weight = whiten @ w[:-1]
        line = kernel.along(weight)
        word = np.concatenate([kernel.sums(vocabulary[k : k + 4096], line) for k in range(0, n, 4096)])
        margin = data.sums(word) + w[-1]
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, of_sentence, margin)
        if r < rounds - 1:
            positive = some(np.flatnonzero(label & (margin >= np.minimum(0.5 * best[of_sentence], 1.0))))
    model = Model(kernel, weight, float(w[-1]), np.zeros(6), 0.5)
    total = data.sums(word)
    f = []
    for d in range(len(y)):
        a, b = data.document[d], data.document[d + 1]
        lo, hi = data.sentence[a], data.sentence[b]
        top = [word[data.words[data.sentence[s] : data.sentence[s + 1]]].max(initial=-np.inf) for s in range(a, b)]
        f.append(_features(total[a:b].tolist(), [t if t > -np.inf else 0.0 for t in top], int(hi - lo)))
    model.scale = _platt(np.array(f), y)
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, label) of the documents training may learn from: ``sample`` of each label at most, by a seeded hash of the id, and of those as many as ``most_bytes`` of text hold.

    Of several texts under one id, the one of the least hash stands for it, so reruns train on the same rows. Longer texts than ``most_bytes`` are not learnt from, and none from the one on that passes it.
    """
    one = labels.where(F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("label"))
    order = [F.xxhash64(F.lit(11), "doc_id"), F.col("doc_id")]
    some = [one.where(F.col("label") == k).orderBy(*order).limit(sample) for k in (0, 1)]
    chosen = some[0].unionByName(some[1])
    fits = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    texts = fits.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    so_far = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("label").orderBy(*order))  # `sample` rows
    return texts.withColumn("so_far_", so_far).where(F.col("so_far_") <= most_bytes).drop("so_far_")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = labelled(docs, labels, "toxic", sample).orderBy("doc_id").select("text", "label").collect()  # 2 * sample rows and 2 * SAMPLE_BYTES at most
    return fit([(r.text, r.label) for r in rows])


def score(docs: DataFrame, spark: SparkSession, model: Model) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, held_out, score, predicted)``, a row a document.

    Null and empty texts get the score of a text without words. Repeated rows score alike. Other columns are ignored.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for b in batches:
            for k in range(0, b.num_rows, 256):
                some = b.slice(k, 256)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(shared.value.scores(some.column(1).to_pylist(), known), pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, spark, train(docs, table(spark, sf_dir, "labels")))
