"""Operator 13: token counts by prefix dynamic programming over a word-level BPE with word ends.

A merge sequence that encodes a string encodes each part between its token borders the same way, so the encoding of a prefix is the
encoding of a shorter prefix and one more token, and it is the only such split whose last border no merge would have closed. From left to right that
gives, for every prefix of a word, its last token and its exact token count, both as an unfinished word and as a whole one. A text is a run of
words; the counts of its words add up to a count at each of its prefixes, and questions of budget and truncation are look-ups in that table.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.shared import table

#: Totals, tables of prefixes and seams that a worker keeps; the memory of a task stays bounded however many distinct words there are.
KEPT, TABLES, SEAMS = 800_000, 50_000, 800_000
#: Characters whose classes and forms are alike in Python and in the library; a text with others is split by the library's own steps.
_PLAIN = regex.compile(r"[\u0000-ԯ‐-‧€　-〩ぁ-ゖァ-ヺ一-龥가-힣\U0001f300-\U0001f64f]*")
#: The split of the vocabulary file, a fixed value.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Where a tree of tokens holds a token's id.
_TOKEN = -1
#: Contractions that the split takes whole and whose beginnings it takes in two.
_LONG_ENDINGS = {"'re", "'ve", "'ll"}


def _bytes_of_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    signs = {chr(b): b for b in own}
    signs.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))})
    return signs


class Vocabulary:
    """Tokens of a vocabulary file, the halves each is merged from, and the counts of words seen."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        model, splits = spec["model"], [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        if model["type"] != "BPE" or splits != [_SPLIT] or any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
            raise ValueError("not a vocabulary of byte-level words with word ends")
        self.library, self.split, self.signs = Tokenizer.from_str(raw.decode()), regex.compile(_SPLIT), _bytes_of_signs()
        special = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)))
        end = model["end_of_word_suffix"]
        self.ids: dict[tuple[bytes, bool], int] = {}  # (bytes, ends a word) -> id
        name = {}
        for t, i in model["vocab"].items():
            whole = t.endswith(end) and len(t) > len(end)
            name[t] = i
            self.ids[bytes(self.signs[c] for c in (t.removesuffix(end) if whole else t)), whole] = i
        self.rank, self.halves = {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            both = name[a], name[b]
            self.rank[both] = r
            self.halves[name[a + b]] = (*both, r)
        self._seams: dict[int, bool] = {}
        reached: set[int] = set()
        for i in sorted(name.values(), key=lambda i: self.halves[i][2] if i in self.halves else -1):
            a, b, r = self.halves.get(i, (i, i, None))
            if r is None or (a in reached and b in reached and not self._closes(a, b, r)):
                reached.add(i)
        # tokens that no string's encoding holds are left out
        self.inner, self.last = ({}, {})
        for (t, whole), i in self.ids.items():
            if i in reached:
                node = self.last if whole else self.inner
                for byte in reversed(t):
                    node = node.setdefault(byte, {})
                node[_TOKEN] = i
        self.counts: dict[str, np.ndarray] = {}
        self.totals: dict[str, int] = {}

    def _closes(self, a: int, b: int, before: int) -> bool:
        """Whether merging ``a``'s and ``b``'s strings joins something across the border between them, by a merge of lower rank than ``before``.

        What lies at the border are the right edge of ``a`` and the left edge of ``b``, each part of them from its own merge to that of what it
        goes into. A merge across happens if both its sides are there before either is used up; of equal merges the left one comes first.
        """
        left, right = [(a, before)], [(b, before)]
        while left[-1][0] in self.halves:
            _, part, r = self.halves[left[-1][0]]
            left.append((part, r))
        while right[-1][0] in self.halves:
            part, _, r = self.halves[right[-1][0]]
            right.append((part, r))
        for x, used in left:
            for y, gone in right:
                r = self.rank.get((x, y))
                # equal ranks: the border's own merge is first on the right edge, not on the left one
                if r is not None and r < used and (r < gone or r == gone < before):
                    return True
        return False

    def apart(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` stay apart where they meet."""
        if len(self._seams) >= SEAMS:
            self._seams.clear()
        found = self._seams[a << 20 | b] = not self._closes(a, b, 1 << 40)
        return found

    def _end(self, word: bytes, j: int, node: dict, tail: list[int], many: list[int]) -> tuple[int, int]:
        """Last token and count of ``word[:j]``: back from its end through the tree of reversed tokens, to the one that stays apart from what precedes it."""
        seams = self._seams
        for i in range(j - 1, 0, -1):
            node = node[word[i]]
            t = node.get(_TOKEN)
            if t is not None:
                apart = seams.get(tail[i] << 20 | t)
                if self.apart(tail[i], t) if apart is None else apart:
                    return t, many[i] + 1
        return node[word[0]][_TOKEN], 1

    def prefixes(self, word: bytes) -> tuple[list[int], list[int]]:
        """Last tokens and counts of the prefixes of 0 to ``len(word) - 1`` bytes, as unfinished words."""
        tail, many = [-1], [0]
        for j in range(1, len(word)):
            t, n = self._end(word, j, self.inner, tail, many)
            tail.append(t)
            many.append(n)
        return tail, many

    def total(self, word: str) -> int:
        found = self.totals.get(word)
        if found is None:
            if len(self.totals) >= KEPT:
                self.totals.clear()
            data = word.encode("utf-8", "replace")
            found = self.totals[word] = self._end(data, len(data), self.last, *self.prefixes(data))[1]
        return found

    def word_table(self, word: str) -> np.ndarray:
        """Counts of the text that ends after each character of ``word``, from the word's start on."""
        found = self.counts.get(word)
        if found is None:
            if len(self.counts) >= TABLES:
                self.counts.clear()
            data = word.encode("utf-8", "replace")
            known = self.prefixes(data)
            found = np.array([self._end(data, int(e), self.last, *known)[1] for e in np.cumsum([len(c.encode("utf-8", "replace")) for c in word])], np.int64)
            if word in _LONG_ENDINGS:
                found[1] = found[0] + self.total(word[1])
            self.counts[word] = found
        return found

    def normal(self, text: str) -> str:
        """Composed, lower-cased and with plain spaces, as the library's normalizer has it."""
        if text.isascii():
            return text.lower()
        if _PLAIN.fullmatch(text):
            return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.library.normalizer.normalize_str(text)

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalized."""
        plain = self.normal(text)
        if plain.isascii() or _PLAIN.fullmatch(plain):
            return self.split.findall(plain)
        return [bytes(self.signs[c] for c in w).decode("utf-8", "replace") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special token's string is one."""
        known, out = self.totals, 0
        if "<|" in text and (found := self.special.findall(text)):
            return len(found) + sum(self.count(part) for part in self.special.split(text))
        for w in self.words(text):
            out += known.get(w) or self.total(w)
        return out

    def chunks(self, text: str) -> Iterator[tuple[int, int]]:
        """(begin, end) of the runs without white space. White space adds no token, joins nothing, and no word or special token holds any."""
        return (m.span() for m in _RUN.finditer(text))

    def chunk_table(self, chunk: str) -> np.ndarray:
        """Counts of the first 1 to ``len(chunk)`` characters of a run without white space.

        Where each character is normalized to one by itself, and no special token is in sight, words' tables follow one another. Else (composed accents
        and the like) every prefix is counted by itself, which takes the square of that run's length.
        """
        plain = self.normal(chunk)
        if "<|" not in chunk and len(plain) == len(chunk) and (chunk.isascii() or plain == "".join(map(self.normal, chunk))) and (plain.isascii() or _PLAIN.fullmatch(plain)):
            out, before = [], 0
            for w in self.split.findall(plain):
                out.append(self.word_table(w) + before)
                before = int(out[-1][-1])
            return np.concatenate(out)
        return np.array([self.count(chunk[:i]) for i in range(1, len(chunk) + 1)], np.int64)

    def text_table(self, text: str) -> np.ndarray:
        """Counts of the first 0 to ``len(text)`` characters."""
        out, before, at = [np.zeros(1, np.int64)], 0, 0
        for begin, end in self.chunks(text):
            out.append(np.full(begin - at, before, np.int64))
            out.append(self.chunk_table(text[begin:end]) + before)
            before, at = int(out[-1][-1]), end
        out.append(np.full(len(text) - at, before, np.int64))
        return np.concatenate(out)

    def fit(self, text: str, limit: int) -> int:
        """Characters of the longest prefix of ``limit`` tokens at most: totals lead to where they run out, and only what stands there needs its table."""
        before, plain = 0, self.normal(text)
        if len(plain) == len(text) and "<|" not in text and (text.isascii() or unicodedata.is_normalized("NFC", text) and _PLAIN.fullmatch(plain)):
            # each character is normalized to one: words have their places in the text
            pieces = ((*m.span(), self.total(m.group()), m.group()) for m in self.split.finditer(plain))
        else:
            pieces = ((begin, end, self.count(text[begin:end]), None) for begin, end in self.chunks(text))
        for begin, end, total, word in pieces:
            if before >= limit:  # any character would be one more
                return begin
            if before + total > limit:
                inside = np.flatnonzero((self.chunk_table(text[begin:end]) if word is None else self.word_table(word)) <= limit - before)
                return begin + int(inside[-1]) + 1 if len(inside) else begin
            before += total
        return len(text)


#: Runs without white space, as the library's expressions have it.
_RUN = regex.compile(r"\S+")
_built: dict[str, Vocabulary] = {}


def vocabulary(raw: bytes) -> Vocabulary:
    """Built once in each Python worker."""
    name = hashlib.sha256(raw).hexdigest()
    if name not in _built:
        _built.clear()
        _built[name] = Vocabulary(raw)
    return _built[name]


def file_bytes(path: str | None = None) -> bytes:
    """A vocabulary file's bytes, read on the driver and broadcast: some MB, whatever the data."""
    import public_tokenizers

    with open(path or public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        return f.read()


def _mapped(docs: DataFrame, spark: SparkSession, path: str | None, columns: str, each) -> DataFrame:
    """``each(vocabulary, texts)`` gives the columns after ``doc_id`` for some texts at a time."""
    shared = spark.sparkContext.broadcast(file_bytes(path))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for b in batches:
            for k in range(0, b.num_rows, 256):  # Python objects of a batch of long texts don't all live at once
                some = b.slice(k, 256)
                yield pa.RecordBatch.from_arrays([some.column(0), *each(v, [t or "" for t in some.column(1).to_pylist()])], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {columns}")


def prefix_counts(docs: DataFrame, spark: SparkSession, path: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, counts array<int>)``: the exact number of tokens of the text's first 0, 1, 2 ... characters.

    ``counts[i]`` is what the library gives for ``text[:i]`` alone. Counts may fall from one character to the next, where a longer word is a shorter
    sequence. Null and empty texts: ``[0]``. Repeated rows are rows of their own. Other columns are ignored. No documents: no rows.
    """
    return _mapped(docs, spark, path, "counts array<int>", lambda v, texts: [pa.array([v.text_table(t).astype(np.int32) for t in texts], pa.list_(pa.int32()))])


def tokens_at(counts: Column | str, at: Column | str) -> Column:
    """How many tokens the first ``at`` characters have (all of them, where the text is shorter), from a table of prefixes."""
    counts, at = (F.col(c) if isinstance(c, str) else c for c in (counts, at))
    return F.element_at(counts, F.least(F.greatest(at.cast("int"), F.lit(0)) + 1, F.size(counts)))


def fits(counts: Column | str, budget: Column | int) -> Column:
    """Characters of the longest prefix of ``budget`` tokens at most, from a table of prefixes. A negative budget: null."""
    counts, budget = F.col(counts) if isinstance(counts, str) else counts, F.lit(budget) if isinstance(budget, int) else budget
    back = F.array_position(F.reverse(F.transform(counts, lambda c: c <= budget)), F.lit(True))
    return F.when(back > 0, (F.size(counts) - back).cast("long"))


def truncated(docs: DataFrame, spark: SparkSession, budget: int, path: str | None = None) -> DataFrame:
    """``(doc_id, text, n_tokens)``: each text's longest prefix of ``budget`` tokens at most. Null texts become empty."""
    if budget < 0:
        raise ValueError("a budget is 0 tokens or more")

    def each(v: Vocabulary, texts: list[str]) -> list[pa.Array]:
        cut = [t[: v.fit(t, budget)] for t in texts]
        return [pa.array(cut, pa.string()), pa.array([v.count(t) for t in cut], pa.int64())]

    return _mapped(docs, spark, path, "text string, n_tokens long", each)


def token_counts(docs: DataFrame, spark: SparkSession, limit: int = 2048, path: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_bytes, n_tokens, over_limit, fit_chars)``, a row a document.

    ``n_tokens`` is the count at the last prefix, special strings one token each; ``fit_chars`` the characters of the longest prefix of ``limit`` tokens at most. Null and
    empty texts have 0 of each. Very long texts and words are counted whole; repeated rows are rows of their own. Other columns are ignored. No documents: no rows.
    """
    if limit < 0:
        raise ValueError("a limit is 0 tokens or more")

    def each(v: Vocabulary, texts: list[str]) -> list[pa.Array]:
        n = [v.count(t) for t in texts]
        fit = [len(t) if k <= limit else v.fit(t, limit) for t, k in zip(texts, n, strict=True)]
        return [pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array(fit, pa.int64())]

    return _mapped(docs, spark, path, "n_bytes long, n_tokens long, over_limit boolean, fit_chars long", each)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), spark)
