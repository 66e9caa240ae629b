"""Conversation repair against brute force over all audits."""

import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import pytest

from fleetscope.llm import conversations
from fleetscope.llm.queries import QUERIES

TURN = "conv_id bigint, turn bigint, role string, text string, kind int, digest string"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [] if kind == 0 else [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Dijkstra over (cost, audit): pops the cheapest, then ASCII-least audit first."""
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, last, made = heapq.heappop(queue)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, made
        if (at, last) in seen:
            continue
        seen.add((at, last))
        for role in ("user", "assistant"):
            if role[0] in NEXT[last]:
                heapq.heappush(queue, (cost + 2, audit + "I", at, role[0], (*made, (role, ""))))
        if at < len(rows):
            role, text, must_go, cut = rows[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, last, made))
            if not must_go:
                if role[:1] and role[0] in NEXT[last]:
                    heapq.heappush(queue, (cost + cut, audit + "K", at + 1, role[0], (*made, (role, text))))
                for other in ("user", "assistant"):
                    if other[0] in NEXT[last]:
                        heapq.heappush(queue, (cost + 2 + cut, audit + "R", at + 1, other[0], (*made, (other, text))))


def plain(rows, ids):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
        groups[conv].append((turn is not None, turn or 0, digest, turn, role, text))
    found = {}
    for conv in ids:
        seen, faults, marked = set(), [0, 0, 0], []
        ordered = sorted(groups[conv], key=lambda r: r[:3])
        for *_, role, text in ordered:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            marked.append((role, text, fault in (0, 1), int(fault == 2)))
        turns = [r[3] for r in ordered if r[3] is not None]
        cost, audit, made = cheapest(marked)
        joined = "\n".join(f"{r}:{t}" for r, t in made)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        found[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults, illegal, cost, audit, hashlib.sha256(joined.encode()).hexdigest())
    return found


ROWS = [
    (1, 0, "system", "Be good."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Yes."), (1, 3, "assistant", "Yes."), (1, 5, "user", "cut off"),
    (2, 0, "assistant", "Begin."), (2, 1, "tool", None), (2, 2, "", "empty role."), (2, 2, "user", "same turn."), (2, None, "user", "first?"), (2, None, None, "no role!"),
    (3, 4, "system", "alone"), (4, 0, "user", " \t\n"), (5, 0, "system", "S."), (5, 9, "system", "S."), (6, 0, "user", "x" * 300000 + "."), (6, 1, "user", "x" * 300000 + "."),
    (None, 0, "user", "Null id."), (None, 0, "user", "Null id."), (None, 1, "assistant", "é ü. "),
]


def rows_of(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_repair_equals_brute_force(frame):
    turns = frame(TURN, [(*r, 1, "x") for r in ROWS])
    want = plain([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in ROWS], {r[0] for r in ROWS})
    assert rows_of(conversations.repair_report(turns)) == want
    assert conversations.repair_report(frame(TURN, [])).count() == 0
    made = conversations.repaired_turns(turns).collect()
    for conv, found in want.items():
        own = sorted((r.position, r.role, r.text) for r in made if r.conv_id == conv)
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in own).encode()).hexdigest() == found[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for _, r, _ in own))


def test_damaged_conversations_equal_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op12_conversations"](spark, small)) == plain(plain_damage(rows), {r[0] for r in rows})


@pytest.mark.parametrize("block", [1, 3])
def test_blocks_join_to_the_same_audit(block):
    import random

    rng = random.Random(3)
    for _ in range(400):
        rows = [(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(1, 9))]
        cuts = [conversations.block_paths(tuple(rows[i:i + block])) for i in range(0, len(rows), block)]
        cost, parts = conversations.join_blocks(cuts)
        want = cheapest([(r, "t", gone, int(cut)) for r, gone, cut in rows])
        assert (cost, "".join(parts)) == want[:2], rows


def test_a_conversation_over_many_ranges(spark, frame):
    rows = [(7, i // 2, "user" if i % 3 else "assistant", f"text {i % 50}.") for i in range(1500)] + [(7, 3, "user", "again.")] * 700 + [(8, 0, "user", "Hi.")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = frame(TURN, [(*r, 1, "x") for r in rows])
        ids = frame("conv_id bigint", [(9,), (8,)])
        found = rows_of(conversations.repair_report(turns, ids))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = plain(rows, {7, 8, 9})
    assert found == want and found[9] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage(frame):
    rows = [(c, t, None if t == 3 else "assistant", None if t == 4 else "One. Two! Three?") for c in (1, 2, None) for t in (None, *range(25))]
    found = conversations.damaged(frame(TURN, [(*r, 1, "x") for r in rows])).collect()
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, plain_damage(rows)))
