"""Operator 8: chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns by turns, the last one an assistant's. Each given turn either
starts a turn of the output, under its own role or another, or is merged into the one before, and empty turns may be put in;
dynamic programming over the automaton of legal turns finds the cheapest way, and the repaired sequence is rendered.

A turn's effect on the automaton is a min-plus matrix of its role, so long conversations are cut into blocks: a block's matrix is the product of
its turns', one pass over the blocks gives the cost of each state before each block, each block then tells for each state at its end which one it
began in, one pass backwards picks those, and blocks are repaired by themselves. Ties fall as they do in one piece, whatever the blocks: to the
lower state, from the end backwards. Output is a row a turn; the pieces of a conversation in order of ``position`` are its rendering.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.shared import stored, table

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or in a turn of that role.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs: a role changed; a role given to a turn with none of the three; merged into its own role; merged into another; an empty turn.
RELABEL, NAME, MERGE, MERGE_OTHER, INSERT = 3.0, 1.0, 1.0, 4.0, 2.0
#: Turn numbers in a block, and rows beyond which a block is cut further.
BLOCK, HEAVY = 1024, 4096
_INF = float("inf")
#: Roles of the empty turns put in between two states, where that is possible at all.
_BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): ("user",), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): ("user",),
    (USER, ASSISTANT): (), (USER, USER): ("assistant",), (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): ("user",),
}
#: Empty turns that finish a conversation from each state.
_FINISH = {START: ("user", "assistant"), SYSTEM: ("user", "assistant"), USER: ("assistant",), ASSISTANT: ()}
_BEGIN = [0.0, _INF, _INF, _INF]
END_COST = [INSERT * len(_FINISH[s]) for s in range(4)]


def _moves(role: int) -> list[list[tuple[float, str, tuple]]]:
    """[from][to]: (cost, action, roles put in before) of the cheapest way for a turn of that role; role 3 is any other."""
    out = [[(_INF, "", ())] * 4 for _ in range(4)]
    for a in range(4):
        for b in (SYSTEM, USER, ASSISTANT):
            ways = []
            own = role == b - 1
            if (a, b) in _BETWEEN:
                put = _BETWEEN[a, b]
                ways.append(((0.0 if own else NAME if role == 3 else RELABEL) + INSERT * len(put), "keep" if own else "relabel", put))
            if a == b:
                ways.append((MERGE if own else NAME if role == 3 else MERGE_OTHER, "merge", ()))
            if ways:
                out[a][b] = min(ways, key=lambda w: w[0])
    return out


MOVES = [_moves(r) for r in range(4)]
MATRIX = [np.array([[MOVES[r][a][b][0] for b in range(4)] for a in range(4)]) for r in range(4)]


def role_code(role: str | None) -> int:
    role = (role or "").strip().lower()
    return ROLES.index(role) if role in ROLES else 3


def _forward(codes: list[int], cost: list[float]) -> tuple[list[float], list[list[int]]]:
    """Costs of the states after the turns, from those before them, and for each turn the state before each state. Ties: lower states."""
    back = []
    for c in codes:
        moves, new, came = MOVES[c], [_INF] * 4, [0] * 4
        for a in range(4):
            if cost[a] < _INF:
                row = moves[a]
                for b in (SYSTEM, USER, ASSISTANT):
                    if (x := cost[a] + row[b][0]) < new[b]:
                        new[b], came[b] = x, a
        cost = new
        back.append(came)
    return cost, back


def _finish(cost: list[float]) -> int:
    return min(range(4), key=lambda s: cost[s] + END_COST[s])


def path(codes: list[int], cost: list[float] | None = None, end: int | None = None) -> list[tuple[int, int]]:
    """(from, to) for each turn on the cheapest path from the start (or from states of the given costs): to ``end``, or, without one, to the cheapest finish."""
    after, back = _forward(codes, _BEGIN if cost is None else cost)
    at = _finish(after) if end is None else end
    out = []
    for came in reversed(back):
        out.append((came[at], at))
        at = came[at]
    return out[::-1]


def _clean(text: str | None) -> str:
    return (text or "").replace("<|", "< |")


def pieces(codes: list[int], texts: list[str | None], steps: list[tuple[int, int]], last: bool) -> Iterator[tuple]:
    """(action, new role, roles put in, cost, rendered piece) of each turn; the last of a conversation closes it."""
    empty = lambda r: f"<|im_start|>{r}\n<|im_end|>\n"
    for k, (code, text, (a, b)) in enumerate(zip(codes, texts, steps, strict=True)):
        cost, action, put = MOVES[code][a][b]
        if action == "merge":
            piece = "\n" + _clean(text)
        else:
            piece = ("<|im_end|>\n" if a != START else "") + "".join(map(empty, put)) + f"<|im_start|>{ROLES[b - 1]}\n" + _clean(text)
        if last and k == len(codes) - 1:
            piece += "<|im_end|>\n" + "".join(map(empty, _FINISH[b]))
            cost, put = cost + END_COST[b], (*put, *(f"+{r}" for r in _FINISH[b]))
        yield action, ROLES[b - 1], ",".join(put), cost, piece


_KEY = ["conv_id", "tb_", "t2_", "hb_", "ib_"]
_ORDER = [*_KEY, "t_", "h_", "id_"]
_K = len(_KEY)
_KEY_TYPES = [pa.int64()] * _K


def _streamed(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of each run of rows with equal first columns, across batches."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, group in groupby(rows, key=lambda r: r[:keys]):
        yield key, list(group)


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 4096) -> Iterator[pa.RecordBatch]:
    hold = []
    for r in rows:
        hold.append(r)
        if len(hold) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hold, strict=True), types, strict=True)], names)
            hold = []
    if hold:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hold, strict=True), types, strict=True)], names)


_OUT = ["conv_id", "position", "turn", "role", "action", "new_role", "inserted", "cost", "rendered"]
_OUT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()]
_OUT_SCHEMA = "conv_id long, position long, turn long, role string, action string, new_role string, inserted string, cost double, rendered string"


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of turns, each with the costs of the states before it, its end state, its place and whether it is its conversation's last."""

    def rows():
        for key, group in _streamed(batches, _K):
            cost, end, first, last = group[0][_K + 3 :]
            codes = [role_code(r[_K + 1]) for r in group]
            steps = path(codes, cost, end)
            for k, (r, out) in enumerate(zip(group, pieces(codes, [r[_K + 2] for r in group], steps, last), strict=True)):
                yield (key[0], first + k, r[_K], r[_K + 1], *out)

    yield from _batches(rows(), _OUT, _OUT_TYPES)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block its matrix and number of turns."""

    def rows():
        for key, group in _streamed(batches, _K):
            m = np.where(np.eye(4) > 0, 0.0, _INF)
            for r in group:
                m = (m[:, :, None] + MATRIX[role_code(r[_K])][None]).min(axis=1)
            yield (*key, m.ravel().tolist(), len(group))

    yield from _batches(rows(), [*_KEY, "m_", "n_"], [*_KEY_TYPES, pa.list_(pa.float64()), pa.int64()])


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from a conversation's first to its last: the costs of the states and the number of turns before each."""

    def rows():
        conv, cost, first = object(), np.array(_BEGIN), 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] != conv:
                    conv, cost, first = r[0], np.array(_BEGIN), 0
                yield (*r[:_K], cost.tolist(), first)
                cost, first = (cost[:, None] + np.array(r[_K]).reshape(4, 4)).min(axis=0), first + r[_K + 1]

    yield from _batches(rows(), [*_KEY, "cost_", "first_"], [*_KEY_TYPES, pa.list_(pa.float64()), pa.int64()])


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the state that it begins in for each state at its end, and the state that it ends in if it is the last."""

    def rows():
        for key, group in _streamed(batches, _K):
            cost, first = group[0][_K + 1 :]
            after, back = _forward([role_code(r[_K]) for r in group], cost)
            at = list(range(4))
            for came in reversed(back):
                at = [came[s] for s in at]
            yield (*key, cost, first, at, _finish(after))

    yield from _batches(rows(), [*_KEY, "cost_", "first_", "from_", "finish_"], [*_KEY_TYPES, pa.list_(pa.float64()), pa.int64(), pa.list_(pa.int32()), pa.int32()])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from a conversation's last to its first: the state that each ends in."""

    def rows():
        conv, end = object(), 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                last = r[0] != conv
                if last:
                    conv, end = r[0], r[_K + 3]
                yield (*r[: _K + 2], end, last)
                end = r[_K + 2][end]

    yield from _batches(rows(), [*_KEY, "cost_", "first_", "end_", "last_"], [*_KEY_TYPES, pa.list_(pa.float64()), pa.int64(), pa.int32(), pa.bool_()])


def format_chats(turns: DataFrame, spark: SparkSession, block: int = BLOCK, heavy: int = HEAVY) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` to ``(conv_id, position, turn, role, action, new_role, inserted, cost, rendered)``, a row a turn.

    Turns are in order of ``turn`` (null: last), ties by hash of role and text, repeated rows in any order, as they are alike; ``position`` counts them from
    0. ``action`` is keep, relabel or merge; ``inserted`` names the empty turns put in before the turn and, marked ``+``, after a conversation's last. Roles
    count trimmed and in any case; null or other roles take any role at small cost. Null texts are empty, very long ones are kept whole. Rows with a null
    ``conv_id`` are one conversation. The template's marks inside texts are broken up. Repeated rows are turns of their own. Other columns are ignored. No
    turns: no rows. ``block`` and ``heavy`` bound what a task holds and change no result.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    order = F.coalesce("turn", F.lit((1 << 63) - 1))
    rows = rows.withColumns({"t_": order, "h_": F.shiftrightunsigned(F.xxhash64("role", "text"), 1), "tb_": order - F.pmod(order, F.lit(block)), "id_": F.monotonically_increasing_id()})
    rows = stored(rows, spark)  # the number of a row must not change when a task is run again
    sizes = rows.groupBy("conv_id", "tb_").agg(F.count("*").alias("n_"))
    # too many rows with turn numbers of one block: cut by number, then by hash, and rows that are alike by row
    cut = sizes.where(F.col("n_") > heavy).select(F.col("conv_id").alias("c_"), F.col("tb_").alias("b_"), F.ceil(F.log2(F.col("n_") / heavy)).cast("int").alias("bits_"))
    rows = rows.join(cut, F.expr("conv_id <=> c_ and tb_ = b_"), "left").withColumns({
        "t2_": F.when(F.col("bits_").isNotNull(), F.col("t_")).otherwise(F.lit(0)).cast("long"),
        "low_": F.expr("coalesce(shiftleft(shiftrightunsigned(h_, 63 - bits_), 63 - bits_), 0L)")}).drop("c_", "b_")
    # a hash of many rows is cut out of its bucket, which goes on behind it, so the order stays that of (turn number, hash, row)
    alike = rows.where("bits_ is not null").groupBy("conv_id", "t_", "low_", "h_").agg(F.count("*").alias("n_")).where(F.col("n_") > heavy)
    alike = alike.groupBy("conv_id", "t_", "low_").agg(F.collect_list("h_").alias("hot_")).select(F.col("conv_id").alias("c_"), F.col("t_").alias("at_"), F.col("low_").alias("lo_"), "hot_")  # a hash for each `heavy` rows at most
    rows = rows.join(alike, F.expr("conv_id <=> c_ and t_ = at_ and low_ = lo_ and bits_ is not null"), "left").withColumns({
        "hb_": F.expr("greatest(low_, array_max(transform(filter(hot_, g -> g <= h_), g -> if(g = h_, g, g + 1))))"),
        "ib_": F.when(F.array_contains("hot_", F.col("h_")), F.floor(F.col("id_") / heavy)).otherwise(F.lit(0)).cast("long")}).drop("c_", "at_", "lo_", "low_", "hot_", "bits_")
    several = rows.select(*_KEY).distinct().groupBy("conv_id").agg(F.count("*").alias("n_")).where("n_ > 1").select(F.col("conv_id").alias("c_"))
    long_ = rows.join(several, F.expr("conv_id <=> c_"), "left_semi")
    short = rows.join(several, F.expr("conv_id <=> c_"), "left_anti")
    columns = [*_KEY, "turn", "role", "text", "cost_", "end_", "first_", "last_"]
    single = short.withColumns({"cost_": F.lit(None).cast("array<double>"), "end_": F.lit(None).cast("int"), "first_": F.lit(0).cast("long"), "last_": F.lit(True)})
    single = single.repartition("conv_id").sortWithinPartitions(*_ORDER).select(columns).mapInArrow(_repair, _OUT_SCHEMA)
    names = ", ".join(f"{k} long" for k in _KEY)
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in _KEY]
    blocks = long_.select(*_ORDER, "role").repartition(*_KEY).sortWithinPartitions(*_ORDER).select(*_KEY, "role").mapInArrow(_matrices, f"{names}, m_ array<double>, n_ long")
    before = stored(blocks.repartition("conv_id").sortWithinPartitions(*_KEY).mapInArrow(_before, f"{names}, cost_ array<double>, first_ long"), spark)
    again = long_.select(*_ORDER, "role").alias("r").join(before.alias("s"), on).select("r.*", "cost_", "first_")
    traces = again.repartition(*_KEY).sortWithinPartitions(*_ORDER).select(*_KEY, "role", "cost_", "first_").mapInArrow(_traces, f"{names}, cost_ array<double>, first_ long, from_ array<int>, finish_ int")
    ends = stored(traces.repartition("conv_id").sortWithinPartitions("conv_id", *[F.desc(c) for c in _KEY[1:]]).mapInArrow(_ends, f"{names}, cost_ array<double>, first_ long, end_ int, last_ boolean"), spark)
    part = long_.alias("r").join(ends.alias("s"), on).select("r.*", "cost_", "end_", "first_", "last_")
    part = part.repartition(*_KEY).sortWithinPartitions(*_ORDER).select(columns).mapInArrow(_repair, _OUT_SCHEMA)
    return single.unionByName(part)


def op8_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"), spark)
