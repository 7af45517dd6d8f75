"""Operator 11: fill-in-the-middle transformation by a table-driven byte automaton.

One automaton reads the bytes of all texts of a batch, each text followed by a byte that UTF-8 never has. Its state knows how much of a character is
still to come, whether a unit (a line) has begun, and how much of a sentinel has been seen; each transition says whether a
character begins, a unit ends or a sentinel is complete. What a state knows are the last few bytes alone, so the buffer is read in many lanes at
once, each of them warmed up on the bytes before it. The transitions that say something are counted by text, and a second pass
finds the places of the cuts among them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.shared import table

#: Before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: What a transition says.
CHARACTER, UNIT, SENTINEL = 1, 2, 4
#: Follows every text in the buffer.
END = 0xFF
#: Bytes that are read at a time (a longer text is read whole), and bytes of a lane.
BUFFER, LANE = 4 << 20, 1024


class Scanner:
    """The automaton's tables: next state and what is said, by state and byte."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        words = [s.encode() for s in sentinels]
        if not all(words) or any(b >= 0x80 or b == 0x0A for w in words for b in w):
            raise ValueError("sentinels are strings of ASCII without line ends")
        seen = sorted({w[:i] for w in words for i in range(len(w))}, key=lambda p: (len(p), p))
        # states: what has been seen of a sentinel (nothing first), a text's or line's begin, bytes missing of a character
        state = {p: i for i, p in enumerate(seen)}
        begin, rest = len(seen), [len(seen) + 1 + k for k in range(3)]
        if (states := len(seen) + 4) > 255:
            raise ValueError("sentinels too long")
        self.begin, self.memory = begin, max(3, *map(len, words))
        goes, says = np.zeros((states, 256), np.intp), np.zeros((states, 256), np.uint8)
        for s in range(states):
            before = seen[s] if s < len(seen) else b""
            for b in range(256):
                to, say = 0, CHARACTER
                if b < 0x80:
                    now = before + bytes([b])
                    say |= SENTINEL * any(now.endswith(w) for w in words) | UNIT * (b == 0x0A)
                    to = begin if b == 0x0A else next(state[now[i:]] for i in range(len(now) + 1) if now[i:] in state)
                elif b < 0xC0:
                    say, to = 0, s - 1 if s in rest[1:] else 0
                elif b < 0xF8:
                    to = rest[0 if b < 0xE0 else 1 if b < 0xF0 else 2]
                elif b == END:
                    to, say = begin, 0 if s == begin else UNIT
                goes[s, b], says[s, b] = to * 256, say
        self.goes, self.says = goes.ravel(), says.ravel()

    def scan(self, data: np.ndarray) -> np.ndarray:
        """What is said at each byte."""
        lanes = -(-len(data) // LANE)
        padded = np.full((lanes, LANE), END, np.uint8)
        padded.ravel()[: len(data)] = data
        state = np.full(lanes, self.begin * 256, np.intp)
        for column in padded[:-1, -self.memory :].T:
            state[1:] = self.goes[state[1:] + column]
        said, columns = np.empty((LANE, lanes), np.uint8), np.ascontiguousarray(padded.T)
        at = np.empty(lanes, np.intp)
        for column, out in zip(columns, said, strict=True):
            np.add(state, column, out=at)
            np.take(self.says, at, out=out)
            np.take(self.goes, at, out=state)
        return np.ascontiguousarray(said.T).ravel()[: len(data)]


def draws(doc_id, seed: int, many: int = 4) -> list[int]:
    """Unsigned 32-bit numbers of a seeded id: the first groups of 8 hex digits of its SHA-256. A null id counts as an empty string."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(found[8 * i : 8 * i + 8], 16) for i in range(many)]


def rearranged(ids: list, texts: list[bytes], scanner: Scanner, sentinels: tuple[str, ...], seed: int, percent: int, spm_percent: int) -> Iterator[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of each text."""
    tokens = [s.encode() for s in sentinels]
    said = scanner.scan(np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8))
    size = np.array([len(t) + 1 for t in texts], np.int64)
    stop = np.cumsum(size)
    start = stop - size
    # counted transitions: units and sentinels of each text
    ends = np.flatnonzero(said & UNIT)
    first = np.searchsorted(ends, start)
    units = np.searchsorted(ends, stop) - first
    marks = np.searchsorted(np.flatnonzero(said & SENTINEL), np.append(start, stop[-1:]))
    chars = np.zeros(len(said) + 1, np.int64)
    np.cumsum(said & CHARACTER, out=chars[1:])
    p, s, m = tokens
    for i, (doc, text) in enumerate(zip(ids, texts, strict=True)):
        n = int(units[i])
        h = draws(doc, seed)
        if not text or marks[i] < marks[i + 1] or h[2] % 100 >= percent:
            yield n, "plain", None, None, text
            continue
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        # second pass: a cut is where a unit ends, after its line end or before the text's end
        a, b = (0 if k == 0 else min(int(ends[first[i] + k - 1]) + 1 - int(start[i]), len(text)) for k in (low, high))
        at = chars[start[i] + np.array([0, a, b])]
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        spm = h[3] % 100 < spm_percent
        out = s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle
        yield n, "spm" if spm else "psm", int(at[1] - at[0]), int(at[2] - at[1]), out


def transform(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n, form, prefix_chars, middle_chars, output)``, a row a document.

    ``n`` counts the lines, with their ends. The seeded id draws two cuts between lines and the form: ``psm`` or ``spm`` with sentinels, or ``plain``, the text
    as it is, for empty texts, texts that hold a sentinel, and those that ``percent`` leaves out; then both numbers are null. Null texts are empty, null ids
    count as an empty string. Rows of one id have the same draws; repeated rows stay rows. Very long texts and lines are read whole. Other columns are ignored. No documents: no rows.
    """
    if len(sentinels) != 3 or len(set(sentinels)) != 3 or any(v in w for v in sentinels for w in sentinels if v is not w) or any(v.startswith(w[i:]) for v in sentinels for w in sentinels for i in range(1, len(w))):
        raise ValueError("three different sentinels, of prefix, suffix and middle, none of which may end like one begins")
    Scanner(tuple(sentinels))  # raises here, not in a task
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(tuple(sentinels))
        for b in batches:
            texts = b.column(1).view(pa.binary())
            total, begin = 0, 0
            for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                total += size + 1
                if total >= BUFFER or i + 1 == b.num_rows:
                    ids = b.column(0).slice(begin, i + 1 - begin)
                    rows = rearranged(ids.to_pylist(), [t or b"" for t in texts.slice(begin, i + 1 - begin).to_pylist()], scanner, tuple(sentinels), seed, percent, spm_percent)
                    n, form, prefix, middle, out = zip(*rows, strict=True)
                    columns = [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).view(pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names)
                    total, begin = 0, i + 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column | str = "form", output: Column | str = "output", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from, as an expression of its form and itself."""
    form, output = (F.col(c) if isinstance(c, str) else c for c in (form, output))
    quoted = "|".join("".join(c if c.isalnum() else "\\" + c for c in s) for s in sentinels)
    part = F.split(output, quoted)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


SQL = r"""with l as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') u, sha256('7:' || coalesce(cast(doc_id as varchar), '')) h from documents),
 d as (select *, len(u) n, cast('0x' || substr(h, 1, 8) as bigint) % (len(u) + 1) a, cast('0x' || substr(h, 9, 8) as bigint) % (len(u) + 1) b,
  cast('0x' || substr(h, 17, 8) as bigint) % 100 >= 100 off, cast('0x' || substr(h, 25, 8) as bigint) % 100 < 50 spm from l),
 f as (select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or off then 'plain' when spm then 'spm' else 'psm' end form,
  array_to_string(u[1:least(a, b)], '') p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') m, array_to_string(u[greatest(a, b) + 1:], '') s from d)
select doc_id, cast(n as bigint) n, form, case when form <> 'plain' then cast(length(p) as bigint) end prefix_chars, case when form <> 'plain' then cast(length(m) as bigint) end middle_chars,
 sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
 sha256(case form when 'plain' then t else p || m || s end) restored_sha256 from f"""
