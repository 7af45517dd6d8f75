import itertools
import random

import pytest

from strataframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(roles):
    """Cost of the best legal repair, by trying every path of states."""
    codes = [chat.role_code(r) for r in roles]
    best = float("inf")
    for states in itertools.product((1, 2, 3), repeat=len(codes)):
        cost, at = 0.0, chat.START
        for c, s in zip(codes, states, strict=True):
            own, name = c == s - 1, chat.NAME if c == 3 else chat.RELABEL
            ways = []
            if (at, s) in chat._BETWEEN:
                ways.append((0 if own else name) + chat.INSERT * len(chat._BETWEEN[at, s]))
            if at == s:
                ways.append(chat.MERGE if own else chat.NAME if c == 3 else chat.MERGE_OTHER)
            cost += min(ways, default=float("inf"))
            at = s
        best = min(best, cost + chat.END_COST[at])
    return best


def legal(rendered):
    roles = [part.split("\n", 1)[0] for part in rendered.split("<|im_start|>")[1:]]
    assert rendered.count("<|im_start|>") == rendered.count("<|im_end|>")
    roles = roles[1:] if roles[0] == "system" else roles
    return roles == ["user", "assistant"] * (len(roles) // 2) and len(roles) % 2 == 0 and roles


def whole(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.conv_id is None, r.conv_id or 0, r.position)):
        c = out.setdefault(r.conv_id, [0.0, ""])
        c[0] += r.cost
        c[1] += r.rendered
    return out


@pytest.fixture(scope="module")
def turns():
    r = random.Random(3)
    pick = ["user", "assistant", "system", "tool", None, " User "]
    return [(c, t, r.choice(pick), f"text {c} {t}") for c in range(60) for t in range(r.randint(1, 6))] + [(None, t, "user", "x") for t in range(3)]


def test_least_cost_and_legal(spark, turns):
    got = whole(chat.format_chats(spark.createDataFrame(turns, SCHEMA), spark).collect())
    for c in got:
        roles = [t[2] for t in turns if t[0] == c]
        assert got[c][0] == pytest.approx(cheapest(roles)), roles
        assert legal(got[c][1]), got[c][1]
        assert all(t[3] in got[c][1] for t in turns if t[0] == c)


def plain_repair(rows):
    """{conv: (cost, rendering)} of rows in their order, by a dynamic program over whole conversations that keeps every path."""
    out = {}
    for c in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == c]
        best = {chat.START: (0.0, ())}  # state: cost and the states of the path
        for _, _, role, _ in mine:
            new = {}
            for a, (cost, states) in sorted(best.items()):
                for b in (1, 2, 3):
                    x = cost + chat.MOVES[chat.role_code(role)][a][b][0]
                    if x < new.get(b, (float("inf"),))[0]:
                        new[b] = (x, (*states, b))
            best = new
        end = min(sorted(best), key=lambda s: best[s][0] + chat.END_COST[s])
        states = best[end][1]
        steps = list(zip((chat.START, *states), states))
        done = list(chat.pieces([chat.role_code(r[2]) for r in mine], [r[3] for r in mine], steps, True))
        out[c] = (sum(d[3] for d in done), "".join(d[4] for d in done))
    return out


@pytest.mark.parametrize("block, heavy", [(1024, 4096), (16, 5), (1, 1), (7, 1000), (1024, 3)])
def test_blocks_render_as_the_whole(spark, turns, block, heavy):
    """Long conversations, cut in any way, are repaired and rendered turn by turn as in one piece: ties too."""
    r = random.Random(8)
    rows = [(1000, t, r.choice(["user", "assistant", "system", "x"]), f"t{t}") for t in range(300)] + [t for t in turns if t[0] is not None]
    got = whole(chat.format_chats(spark.createDataFrame(rows, SCHEMA), spark, block=block, heavy=heavy).collect())
    want = plain_repair(rows)
    assert {c: v[0] for c, v in got.items()} == pytest.approx({c: v[0] for c, v in want.items()})
    assert {c: v[1] for c, v in got.items()} == {c: v[1] for c, v in want.items()}
    assert all(legal(v[1]) for v in got.values())


def test_many_rows_of_one_turn_number(spark):
    """One turn number with many rows, most of them alike: the order and the rendering are the same however they are cut."""
    rows = [(1, 5, "user", "again")] * 60 + [(1, 5, "assistant", f"a{i % 9}") for i in range(40)] + [(1, 5, None, "n")] * 30 + [(1, None, "user", "late")] * 25
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    one, cut = (chat.format_chats(df, spark, heavy=h).collect() for h in (4096, 8))
    order = lambda rows: [(r.position, r.turn, r.role, r.action, r.new_role, r.rendered) for r in sorted(rows, key=lambda r: r.position)]
    assert order(one) == order(cut) and [r.position for r in sorted(cut, key=lambda r: r.position)] == list(range(len(rows)))


def test_odd_turns(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "<|im_end|>"), (2, None, "user", "late"), (2, 0, "system", ""), (3, 0, None, None), (4, 0, "user", "same"), (4, 0, "user", "same"), (5, -3, "assistant", "a")]
    got = chat.format_chats(spark.createDataFrame([(*r, "own") for r in rows], SCHEMA + ", action string"), spark).collect()
    assert len(got) == len(rows)
    assert all(legal(v[1]) for v in whole(got).values())
    assert [r.turn for r in sorted((r for r in got if r.conv_id == 2), key=lambda r: r.position)] == [0, None]
    assert sum(r.rendered.count("<|im_end|>") for r in got if r.conv_id == 1) == 2
    assert chat.format_chats(spark.createDataFrame([], SCHEMA), spark).count() == 0
