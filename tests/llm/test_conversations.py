"""Conversation repair against plain dynamic programming over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from papyrion.llm.conversations import Automaton, Repair, damage, repaired_conversations

WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    """Every conversation's report."""
    groups = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, kind = role if role is not None else " ", text if text is not None else " ", zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, items in groups.items():
        items.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in items:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))

        cost, audit, repaired = plain(items, faults)
        turns = [t for t, _, _ in items if t is not None]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(items, items[1:])),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),
        )
    return out


def plain(items, faults):
    """Forward sets of the cheapest (cost, audit, rows) by state, up to two inserts between rows."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    whole = {"u": "user", "a": "assistant"}

    def inserted(states):
        for _ in range(4):
            for q, (c, a, r) in list(states.items()):
                for new in "ua":
                    if new in follows[q]:
                        put(states, new, (c + 3, a + "I", (*r, (whole[new], ""))))
        return states

    def put(states, q, found):
        if q not in states or found[:2] < states[q][:2]:
            states[q] = found

    # ties must be broken over whole audits, so all of a state's cheapest audits compete by their text: prefixes of equal length of rows compare alike
    states = inserted({"": (0, "", ())})
    for (_, role, text), fault in zip(items, faults, strict=True):
        behind = {}
        for q, (c, a, r) in states.items():
            put(behind, q, (c + 4, a + "D", r))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[0] in follows[q]:
                    put(behind, role[0], (c + more, a + "K", (*r, (role, text))))
                for new in "ua":
                    if new in follows[q]:
                        put(behind, new, (c + 3 + more, a + "R", (*r, (whole[new], text))))
        states = inserted(behind)
    return min((v for q, v in states.items() if q in ("", "a")), key=lambda x: x[:2])


def made(seed=4, count=300):
    rng = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in range(rng.randrange(0, 9)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "User", "", None])
            text = rng.choice(["Yes.", "Yes.", "What is it?", "no end", "", " \t\n", None, "long " * 30 + "!", "é ü.", "Well!\n"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    rows += [(None, 0, "user", "Hello."), (None, None, "assistant", "So."), (-1, None, None, None), (-2, 3, "user", "x" * 300_000 + ".")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("piece", [1 << 16, 2])
def test_against_plain_search(spark, piece):
    rows = made()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{SCHEMA}, c string, place int").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in repaired_conversations(frame, piece).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for conv in want:
        assert got[conv] == want[conv], conv


def test_one_long_conversation_in_pieces(spark):
    rng = random.Random(1)
    rows = [(7, t, rng.choice(["system", "user", "assistant", "assistant"]), rng.choice(["Yes.", "No", "", f"{t}.", f"{t}?"])) for t in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)[7]
    for piece in (64, 700):
        (row,) = repaired_conversations(frame, piece).collect()
        assert tuple(row)[1:] == want


def test_cost_is_the_sum_of_the_edits(spark):
    rows = made(9, 80)
    repair = Repair(damage(spark.createDataFrame(rows, SCHEMA)), 3)
    cost = defaultdict(int)
    for r in repair.rows.collect():
        bare = r.text.rstrip(WHITE)
        cost[r.c] += 3 * (len(r.before) + len(r.after)) + {"D": 4, "K": 0, "R": 3}[r.edit] + 3 * (r.edit != "D" and bare[-1] not in ".!?")
    assert {r.c: r.cost for r in repair.conversations.collect()} == dict(cost)


def test_the_table_is_finite():
    assert 4 <= Automaton().all_vectors() < 200


def test_empty(spark):
    assert repaired_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
