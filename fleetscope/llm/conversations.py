"""Conversation structure repair: cheapest edits that give system? (user assistant)+, by shortest paths over big-integer weights."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetscope.llm.frames import WHITE

#: Rows of a conversation that one shortest-path problem holds; longer conversations are cut and their parts joined.
BLOCK = 512
#: Edits as octal digits in ASCII order, 0 pads the end.
_DIGITS, _LETTERS = str.maketrans("DIKR", "1234"), str.maketrans("1234", "DIKR")
#: States: start, after the system turn, after a user turn, after an assistant turn; the next state by the role's initial.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state that an inserted or reroled turn leads to, and that turn's role.
_FILL, _ROLE = (2, 2, 3, 2), {2: "user", 3: "assistant"}
#: What completes a conversation that ends in a state.
_END = ("", "II", "I", "")
_LEGAL = frozenset(("su", "ua", "au"))
_FAR = 1 << 50  # a cost that no path has

_BLOCKS = ("conv_id bigint, turn bigint, digest string, at bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, "
           "low bigint, high bigint, turns bigint, last_turn bigint, costs array<bigint>, audits array<string>")
_PLANNED = "conv_id bigint, turn bigint, digest string, at bigint, audit string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
_REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_TURNS = "conv_id bigint, position bigint, role string, text string, edit string"


def _before(weight: int, cost: int, audit: str, bits: int) -> int:
    """The weight of a path with edges of this cost and audit in front. The cost stands above ``bits``, the audit's digits at their places
    from the left below, so plain integers compare by cost, then by audit, a shorter one before its continuations."""
    if not audit:
        return weight + (cost << bits)
    shift = 3 * len(audit)
    high, low = weight >> bits, weight & ((1 << bits) - 1)
    return (high + cost) << bits | int(audit.translate(_DIGITS), 8) << (bits - shift) | low >> shift


def _audit(weight: int, bits: int) -> str:
    return format(weight & ((1 << bits) - 1), "o").zfill(bits // 3).rstrip("0").translate(_LETTERS) if bits else ""


@lru_cache(1 << 12)
def block_paths(rows: tuple[tuple[str, bool, bool], ...], limit: int = 2) -> list[list[tuple[int, str] | None]]:
    """Cheapest (cost, audit) through the rows from each state (first index) to each state (second), None where there is no way.

    A row is (initial of the role, whether it must go, whether it is truncated). Before each row up to ``limit`` turns may be inserted - a
    third would repeat the state after the first at a higher cost - then the row is deleted, kept if its role fits, or reroled.
    Short conversations repeat the same rows in this sense, so the last few thousand answers are kept.
    """
    bits = 3 * (limit + 1) * len(rows)
    found: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for end in range(4):
        best = [_FAR << bits] * 4
        best[end] = 0
        for initial, must_go, truncated in reversed(rows):
            edited = []
            for state in range(4):
                ways = [_before(best[state], 3, "D", bits)]
                if not must_go:
                    ways.append(_before(best[_FILL[state]], 2 + truncated, "R", bits))
                    if (state, initial) in _NEXT:
                        ways.append(_before(best[_NEXT[state, initial]], int(truncated), "K", bits))
                edited.append(min(ways))
            best = []
            for state in range(4):
                ways, at = [edited[state]], state
                for times in range(1, limit + 1):
                    at = _FILL[at]
                    ways.append(_before(edited[at], 2 * times, "I" * times, bits))
                best.append(min(ways))
        for state, weight in enumerate(best):
            if weight >> bits < _FAR:
                found[state][end] = (weight >> bits, _audit(weight, bits))
    return found


def join_blocks(blocks: list[list[list[tuple[int, str] | None]]]) -> tuple[int, list[str]]:
    """The cheapest cost through all blocks, and each block's part of the audit; what is inserted at the end follows the last part."""
    bits = 3 * (sum(max((len(way[1]) for ways in b for way in ways if way), default=0) for b in blocks) + 2)
    best = [_before(0, 2 * len(end), end, bits) for end in _END]
    chosen: list[list[int]] = []
    for paths in reversed(blocks):
        ways = [[_before(best[end], *way, bits) if way else _FAR << bits for end, way in enumerate(row)] for row in paths]
        chosen.append([row.index(min(row)) for row in ways])
        best = [min(row) for row in ways]
    state, parts = 0, []
    for paths, to in zip(blocks, reversed(chosen)):
        parts.append(paths[state][to[state]][1])
        state = to[state]
    parts[-1] += _END[state]
    return best[0] >> bits, parts


class _Block:
    """Rows of one conversation that follow each other in a sorted range."""

    def __init__(self, conv: int | None, turn: int | None, digest: str, at: int):
        self.key, self.rows = (conv, turn, digest, at), []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns: list[int | None] = []

    def add(self, turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if self.rows and self.rows[-1][0] + initial not in _LEGAL:
            self.illegal += 1
        self.blank += blank
        self.duplicate += duplicate and not blank
        cut = truncated and not blank and not duplicate
        self.truncated += cut
        self.rows.append((initial, blank or duplicate, cut))
        if not self.turns or self.turns[-1] != turn:
            self.turns.append(turn)

    def record(self) -> tuple:
        paths = block_paths(tuple(self.rows))
        known = [t for t in self.turns if t is not None]
        return (*self.key, len(self.rows), self.blank, self.duplicate, self.truncated, self.illegal, self.rows[0][0], self.rows[-1][0],
                known[0] if known else None, known[-1] if known else None, len(known), self.turns[-1],
                [way[0] if way else None for ways in paths for way in ways], [way[1] if way else None for ways in paths for way in ways])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = [f.strip().split(" ") for f in ddl.split(",")]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as blocks. A row of n equal ones is n turns, all but the first of which are duplicates."""
    block = None
    for batch in batches:
        done = []
        for conv, turn, digest, n, initial, blank, truncated, duplicate in zip(*(c.to_pylist() for c in batch.columns)):
            for at in range(n):
                if block is None or block.key[0] != conv or len(block.rows) == BLOCK:
                    if block is not None:
                        done.append(block.record())
                    block = _Block(conv, turn, digest, at)
                block.add(turn, initial, blank, duplicate or at > 0, truncated)
        yield _batch(done, _BLOCKS)
    yield _batch([block.record()] if block is not None else [], _BLOCKS)


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the blocks of each conversation, which arrive in order; the totals stand on its first block."""
    held: list[dict] = []

    def planned() -> list[tuple]:
        cost, parts = join_blocks([[[None if c is None else (c, a) for c, a in list(zip(b["costs"], b["audits"]))[4 * s:4 * s + 4]] for s in range(4)] for b in held])
        illegal = sum(b["illegal"] for b in held) + sum(a["tail"] + b["head"] not in _LEGAL for a, b in zip(held, held[1:]))
        lows, highs = [b["low"] for b in held if b["low"] is not None], [b["high"] for b in held if b["high"] is not None]
        distinct = sum(b["turns"] for b in held) - sum(b["turn"] is not None and a["last_turn"] == b["turn"] for a, b in zip(held, held[1:]))
        totals = (max(highs) - min(lows) + 1 - distinct if lows else 0, *(sum(b[k] for b in held) for k in ("blank", "duplicate", "truncated")), illegal, cost)
        return [(b["conv_id"], b["turn"], b["digest"], b["at"], part, *(totals if i == 0 else (None,) * 6)) for i, (b, part) in enumerate(zip(held, parts))]

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if held and held[0]["conv_id"] != row["conv_id"]:
                done += planned()
                held.clear()
            held.append(row)
        yield _batch(done, _PLANNED)
    yield _batch(planned() if held else [], _PLANNED)


class _Conversation:
    """Applies a conversation's audit to its turns as they pass by."""

    def __init__(self, conv: int | None):
        self.conv, self.state, self.position, self.audit = conv, 0, 0, []
        self.totals, self.ahead, self.sha = (0,) * 6, deque(), hashlib.sha256()

    def plan(self, audit: str, totals: tuple) -> None:
        self.audit.append(audit)
        self.ahead.extend(audit)
        if totals[0] is not None:
            self.totals = totals

    def _put(self, role: str, text: str, edit: str) -> tuple:
        self.sha.update(("\n" if self.position else "").encode() + f"{role}:{text}".encode())
        self.position += 1
        return self.conv, self.position, role, text, edit

    def inserted(self) -> Iterator[tuple]:
        while self.ahead and self.ahead[0] == "I":
            self.ahead.popleft()
            self.state = _FILL[self.state]
            yield self._put(_ROLE[self.state], "", "I")

    def turn(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.ahead.popleft()
        if edit == "R":
            self.state = _FILL[self.state]
            yield self._put(_ROLE[self.state], text, "R")
        elif edit == "K":
            self.state = _NEXT[self.state, role[:1]]
            yield self._put(role, text, "K")

    def report(self) -> tuple:
        return self.conv, *self.totals, "".join(self.audit), self.sha.hexdigest()


def _apply(turns: bool):
    ddl = _TURNS if turns else _REPORT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def end() -> list[tuple]:
            rest = list(now.inserted()) if now is not None else []
            return rest if turns else [now.report()] if now is not None else []

        for batch in batches:
            done = []
            for conv, kind, audit, role, text, *totals in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv != conv:
                    done += end()
                    now = _Conversation(conv)
                if kind == 0:
                    now.plan(audit, tuple(totals))
                elif kind == 1:
                    made = list(now.turn(role, text))
                    done += made if turns else []
            yield _batch(done, ddl)
        yield _batch(end(), ddl)

    return run, ddl


def _rows(turns: DataFrame) -> DataFrame:
    """Turns with a digest of role and text. Nulls of role and text count as one space."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    return rows.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def _blocks(rows: DataFrame) -> DataFrame:
    """Every conversation's turns as blocks with their cheapest paths; no text moves for this."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    blank: Column = bare == ""
    ends = F.substring(bare, -1, 1).isin(".", "!", "?")
    groups = rows.groupBy("conv_id", "turn", "digest", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), (~blank & ~ends).alias("truncated")).agg(F.count("*").alias("n"))
    first = groups.where("not blank").groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("times")).where("times > 1")
    first = first.select(F.col("conv_id").alias("f_conv"), F.col("digest").alias("f_digest"), "first")
    marked = groups.join(first, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("digest") == F.col("f_digest")), "left")
    again = F.col("first").isNotNull() & ~F.col("blank") & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    key = ["conv_id", "turn", "digest"]
    marked = marked.select(*key, "n", "initial", "blank", "truncated", again.alias("duplicate"))
    return marked.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_cut, _BLOCKS)


def _repaired(turns: DataFrame, conversations: DataFrame | None, emit_turns: bool) -> DataFrame:
    rows = _rows(turns)
    order = ["conv_id", "turn", "digest", "at"]
    planned = _blocks(rows).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_plan, _PLANNED)
    totals = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    plans = planned.select("conv_id", "turn", "digest", F.lit(0).alias("kind"), "at", "audit", *none("string", "role", "text"), *totals)
    texts = rows.select("conv_id", "turn", "digest", F.lit(1).alias("kind"), *none("bigint", "at"), *none("string", "audit"), "role", "text", *none("bigint", *totals))
    every = plans.unionByName(texts)
    if conversations is not None:
        ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
        every = every.unionByName(ids.select("conv_id", *none("bigint", "turn"), *none("string", "digest"), F.lit(-1).alias("kind"), *none("bigint", "at"), *none("string", "audit", "role", "text"),
                                             *none("bigint", *totals)))
    run, ddl = _apply(emit_turns)
    ordered = every.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest", "kind", "at")
    return ordered.select("conv_id", "kind", "audit", "role", "text", *totals).mapInArrow(run, ddl)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, position, role, text, edit), edit K (kept), R (role changed) or I (inserted, empty text). See ``repair_report``."""
    return _repaired(turns, None, True)


def repair_report(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Return (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conversation of ``turns`` (conv_id, turn,
    role, text), and for every conv_id of ``conversations``: zeros, an empty audit and the hash of the empty text where it has no turns.

    A conversation is cut into blocks of at most 512 turns wherever the sorted ranges lie. In a block, shortest paths lead from each of four
    states to each: edges are edits, a path's weight is one integer with the cost in its high digits and the edits as octal digits
    at fixed places from the left in its low ones, ends padded with zeros, so the least integer is the cheapest audit and of
    those the ASCII-least. Blocks join in the same way: two paths through a block between the same states and of the same cost are never one
    the beginning of the other, since the rest would be inserted turns, which cost. So a conversation of any length is spread over tasks for the
    choice of edits. Then turns pass once, sorted, a batch at a time, and the edits apply. The hash is sequential by its definition, so one
    task reads one conversation's turns for it; the audit is one cell of a letter or so a turn.

    Turns of equal number are ordered by a digest of role and text. Rows that repeat number, role and text are counted before they
    shuffle; all but the first are duplicates. A null conv_id is a conversation of its own; null roles and texts count as one space; null turn
    numbers come first and are left out of ``gaps``. Texts of any length pass through as they are. An empty table gives no rows.
    """
    return _repaired(turns, conversations, False)


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with planted faults by crc32("conv_id:turn") % 20: 0 drops the row, 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 sets
    its role to user. Nulls count as one space, but a null turn stays null."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(space("role")).alias("role"), text.alias("text"), kind.alias("kind"), F.explode(times).alias("copy")).where(
        "kind <> 0").select("conv_id", "turn", "role", "text")
