"""Repair of the structure of conversations by the cheapest edits (operator 13).

A repaired conversation is empty or has, after an optional system message, messages of user and assistant by turns.
What may follow depends on one of four states, so the cheapest way from any message on is a table of four costs. The
tables are filled from the last message back, for all conversations of a bucket of similar lengths at once: arrays
have the messages as their first axis, the conversations as the second, the states as the third. Edits are then
traced forward, again for all of them at once, along the costs that were stored; of edits that cost the same the
first in ASCII is taken, which makes the whole audit the least.

Rows are range-sorted by conversation and turn and cut into blocks: most conversations are one block. A conversation
of any length is several, in several partitions. Its blocks have costs from every state to every state; these
small matrices, one a block, are what meets in one place, and give each block the costs behind it and the state
before it. Blocks are traced apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigwright.runtime import Cut, release_memory, shuffle_partitions

#: Rows and bytes of text of a block, about.
BLOCK_ROWS = 4096
BLOCK_BYTES = 4 << 20
#: Messages times conversations of one tensor, about.
TENSOR = 1 << 19
BLANKS = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
BLANK_ROW, REPEATED_ROW, TRUNCATED_ROW = 1, 2, 3
FAR = np.int64(1) << np.int64(50)
#: States: 0 nothing yet, 1 behind system, 2 behind user, 3 behind assistant. What a new message, and one that is kept
#: as system, user or assistant, leads to; -1: not allowed.
NEXT = np.array([2, 2, 3, 2])
KEPT = np.array([[-1, -1, -1, -1], [1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1]])
#: Costs where no message is left: what is missing of a pair is inserted.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
EDITS = np.frombuffer(b"DIKR", np.uint8)


def damaged(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text and times (0 to 2, how often a row is there) of every row of messages after damage by
    crc32 of ``conv_id:turn`` mod 20: 0 drops a row, 1 empties its text, 2 takes its ``[.!?]``, 3 repeats it, 4 makes its role
    user. Nulls in the key, roles and texts are one blank."""
    blank = F.lit(" ")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    how = F.crc32(F.concat(text_of(conv), F.lit(":"), text_of(turn)).cast("binary")) % 20
    return messages.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.when(how == 4, "user").otherwise(text_of(role)).alias("role"),
        F.when(how == 1, "").when(how == 2, F.regexp_replace(text_of(text), "[.!?]", "")).otherwise(text_of(text)).alias("text"),
        F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("times"),
    )


def fault(text: str, again: bool) -> int:
    solid = text.rstrip(BLANKS)
    if not solid:
        return BLANK_ROW
    return REPEATED_ROW if again else 0 if solid[-1] in ".!?" else TRUNCATED_ROW


def lawful(first: str, second: str) -> bool:
    """Whether two messages may stand side by side, by the first letters of their roles."""
    return first[:1] + second[:1] in ("su", "ua", "au")


@dataclass
class _Open:
    """The block that is being filled."""

    conv: object = None
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    codes: bytearray = field(default_factory=bytearray)
    seen: set = field(default_factory=set)
    turns: list = field(default_factory=list)
    illegal: int = 0
    size: int = 0
    cut: bool = False

    def add(self, turn, role: str, text: str) -> None:
        again = (role, text) in self.seen
        if not again:
            self.seen.add((role, text))
        self.codes.append("sua".find(role[:1]) + 1 << 2 | fault(text, again) if role else fault(text, again))
        if self.roles and not lawful(self.roles[-1], role):
            self.illegal += 1
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)


def _blocks(rows: DataFrame) -> DataFrame:
    """One row for each block: its conversation, place (part, seq), roles, texts and codes (role letter and fault by
    row), what concerns turns, and whether the conversation may have other blocks (cut)."""
    schema = T.StructType([
        rows.schema["conv_id"], T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("cut", T.BooleanType()),
        T.StructField("first_turn", rows.schema["turn"].dataType), T.StructField("last_turn", rows.schema["turn"].dataType), T.StructField("turns", T.LongType()),
        T.StructField("illegal", T.LongType()), T.StructField("codes", T.BinaryType()), T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.StringType())),
    ])
    order = ["conv_id", "turn", "role"]
    # texts are in order only among equal rows of one turn: their beginnings are enough to cut ranges
    ranged = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out, held = TaskContext.get().partitionId(), 0, [], 0
        block: _Open | None = None

        def closed(b: _Open, cut: bool) -> tuple:
            ends = (b.turns[0], b.turns[-1]) if b.turns else (None, None)
            return b.conv, part, seq, cut, *ends, len(b.turns), b.illegal, bytes(b.codes), b.roles, b.texts

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=schema.names)

        types = None
        for batch in batches:
            if types is None:
                conv_type, turn_type = batch.schema.types[:2]
                types = [conv_type, pa.int32(), pa.int32(), pa.bool_(), turn_type, turn_type, pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string())]
            for conv, turn, role, text, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block is None or conv != block.conv:
                    if block is not None:
                        out.append(closed(block, block.cut or seq == 0))
                        held, seq = held + block.size, seq + 1
                    block = _Open(conv)
                elif len(block.roles) >= BLOCK_ROWS or block.size >= BLOCK_BYTES:
                    out.append(closed(block, True))
                    held, seq = held + block.size, seq + 1
                    block = _Open(conv, cut=True)
                if held >= BLOCK_BYTES or len(out) >= 2000:
                    yield batch_of(out)
                    out, held = [], 0
                for _ in range(times):
                    block.add(turn, role, text)
        if block is not None:
            out.append(closed(block, True))
            yield batch_of(out)
        release_memory()

    return ranged.mapInArrow(run, schema)


@dataclass
class Tensor:
    """Backward costs of conversations of similar lengths: kind and fault are messages x conversations, costs has one
    row of messages more and the states as a third axis. Behind its last message a conversation keeps its costs."""

    kind: np.ndarray
    fault: np.ndarray
    length: np.ndarray
    costs: np.ndarray

    @classmethod
    def of(cls, codes: list[bytes], behind: np.ndarray) -> Tensor:
        """behind: conversations x 4, the costs behind the last message."""
        length = np.array([len(c) for c in codes], np.int64)
        most = int(length.max(initial=0))
        code = np.frombuffer(b"".join([c.ljust(most, b"\0") for c in codes]), np.uint8).reshape(len(codes), most).T
        kind, fault = (code >> 2).astype(np.int64), code & 3
        costs = np.empty((most + 1, len(codes), 4), np.int64)
        costs[most] = behind
        for t in range(most - 1, -1, -1):
            there = (t < length)[:, None]
            best = np.minimum(DELETE + costs[t + 1], np.minimum(*cls.stays(kind[t], fault[t], costs[t + 1])))
            # a new message leads from assistant to user and back, and from the beginning to user
            best[:, 2], best[:, 3] = np.minimum(best[:, 2], INSERT + best[:, 3]), np.minimum(best[:, 3], INSERT + best[:, 2])
            best[:, :2] = np.minimum(best[:, :2], INSERT + best[:, 2:3])
            costs[t] = np.where(there, best, costs[t + 1])
        return cls(kind, fault, length, costs)

    @staticmethod
    def stays(kind: np.ndarray, fault: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs, conversations x 4, of keeping a message and of giving it the role that its place asks for."""
        more = np.where((fault == BLANK_ROW) | (fault == REPEATED_ROW), FAR, np.where(fault == TRUNCATED_ROW, TRUNCATED, 0))[:, None]
        to = KEPT[kind]
        keep = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 1), FAR)
        return more + keep, more + REROLE + after[:, NEXT]

    def trace(self, state: np.ndarray, last: np.ndarray) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
        """(edits, states behind each edit, state behind all) of each conversation from a state on; last: whether nothing
        follows, so that what is missing of a pair is inserted."""
        n = len(self.length)
        state, at = state.astype(np.int64).copy(), np.zeros(n, np.int64)
        edits, states = [], []
        live = np.arange(n)
        while len(live):
            t, s = at[live], state[live]
            ended = t >= self.length[live]
            live = live[~ended | (last[live] & ((s == 1) | (s == 2)))]
            if not len(live):
                break
            t, s = at[live], state[live]
            ended = t >= self.length[live]
            row = np.minimum(t, max(0, len(self.kind) - 1))
            now, new = self.costs[t, live, s], self.costs[t, live, NEXT[s]]
            after = self.costs[np.minimum(t + 1, len(self.costs) - 1), live]
            edit, to = np.ones(len(live), np.int64), NEXT[s]
            if len(self.kind):
                kind, one = self.kind[row, live], np.arange(len(live))
                keep, rerole = self.stays(kind, self.fault[row, live], after)
                # from the last edit in ASCII to the first: the first that reaches the cost stays
                for number, cost, goes in ((3, rerole[one, s], NEXT[s]), (2, keep[one, s], KEPT[kind, s]), (1, INSERT + new, NEXT[s]), (0, DELETE + after[one, s], s)):
                    fits = (cost == now) & ~ended
                    edit, to = np.where(fits, number, edit), np.where(fits, goes, to)
            state[live], at[live] = to, t + (edit != 1)
            letter, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
            letter[live], behind[live] = EDITS[edit], to
            edits.append(letter)
            states.append(behind)
        if not edits:
            return [b""] * n, [np.zeros(0, np.uint8)] * n, state
        letters, behind = np.stack(edits, 1), np.stack(states, 1)
        steps = (letters > 0).sum(1)
        return [letters[i, : steps[i]].tobytes() for i in range(n)], [behind[i, : steps[i]] for i in range(n)], state


def tensors(codes: list[bytes], behind: np.ndarray) -> Iterator[tuple[np.ndarray, Tensor]]:
    """(numbers of the conversations, their tensor) by buckets of lengths: each at most twice as long as another."""
    length = np.array([len(c) for c in codes], np.int64)
    bucket = np.ceil(np.log2(np.maximum(length, 1))).astype(int)
    for b in np.unique(bucket):
        members = np.flatnonzero(bucket == b)
        step = max(1, TENSOR >> b)
        for i in range(0, len(members), step):
            some = members[i : i + step]
            yield some, Tensor.of([codes[k] for k in some], behind[some])


def repaired_lines(edits: bytes, states: np.ndarray, roles: list[str], texts: list[str]) -> list[str]:
    """The messages, as ``role:text``, that edits make of a conversation."""
    out, at = [], 0
    for edit, state in zip(edits, states.tolist(), strict=True):
        given = "user" if state == 2 else "assistant"
        if edit == 73:
            out.append(f"{given}:")
            continue
        if edit != 68:
            out.append(f"{roles[at] if edit == 75 else given}:{texts[at]}")
        at += 1
    return out


def _hashes(role: str, text: str) -> int:
    return xxhash.xxh3_128_intdigest(f"{len(role)}:{role}{text}".encode())


def _repeats(blocks: DataFrame) -> DataFrame:
    """(conv, part, seq, again array<struct<high, low>>): hashes of the messages of blocks that an earlier block of the
    conversation has."""
    known = blocks.select("conv", "part", "seq", "roles", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = np.array([divmod(h, 1 << 64) for h in {_hashes(r, t) for r, t in zip(row["roles"], row["texts"], strict=True)}], np.uint64).reshape(-1, 2).view(np.int64)
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array([row["conv"]] * n, pa.string()), pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["seq"], np.int32)), pa.array(own[:, 0].copy()), pa.array(own[:, 1].copy())], names=["conv", "part", "seq", "high", "low"])

    hashes = known.mapInArrow(run, "conv string, part int, seq int, high long, low long")
    first = hashes.groupBy("conv", "high", "low").agg(F.min(F.struct("part", "seq")).alias("first"), F.max(F.struct("part", "seq")).alias("last")).filter("first <> last").drop("last")
    late = hashes.join(first, ["conv", "high", "low"]).filter(F.struct("part", "seq") > F.col("first"))
    return late.groupBy("conv", "part", "seq").agg(F.collect_list(F.struct("high", "low")).alias("again"))


def _chained(blocks: DataFrame) -> DataFrame:
    """blocks (conv, part, seq, codes, ...) of conversations of several blocks with entry (the state before), behind (costs
    behind) and last."""
    cells = blocks.select("conv", "part", "seq", "codes")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(3).to_pylist()
            out = np.empty((len(codes), 4, 4), np.int64)
            for to in range(4):
                behind = np.full((len(codes), 4), FAR)
                behind[:, to] = 0
                for some, tensor in tensors(codes, behind):
                    out[some, :, to] = tensor.costs[0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(out.reshape(-1, 16)), pa.list_(pa.int64()))], names=["conv", "part", "seq", "cells"])

    def costs_behind(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("seq", "ascending")])
        cells = np.array(group.column("cells").to_pylist(), np.int64).reshape(-1, 4, 4)
        behind = np.empty((len(cells), 4), np.int64)
        behind[-1] = END
        for i in range(len(cells) - 1, 0, -1):
            behind[i - 1] = (cells[i] + behind[i]).min(1)
        last = np.arange(len(cells)) == len(cells) - 1
        return group.drop_columns(["cells"]).append_column("behind", pa.array(list(behind), pa.list_(pa.int64()))).append_column("last", pa.array(last))

    def moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, behind = batch.column(3).to_pylist(), np.array(batch.column(4).to_pylist(), np.int64).reshape(-1, 4)
            last = batch.column(5).to_numpy(zero_copy_only=False)
            out = np.empty((len(codes), 4), np.int64)
            for some, tensor in tensors(codes, behind):
                for state in range(4):
                    out[some, state] = tensor.trace(np.full(len(some), state), last[some])[2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(out), pa.list_(pa.int64()))], names=["conv", "part", "seq", "moves"])

    def entries(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("seq", "ascending")])
        state, out = 0, []
        for row in group.column("moves").to_pylist():
            out.append(state)
            state = row[state]
        return group.drop_columns(["moves"]).append_column("entry", pa.array(out, pa.int32()))

    place = ["conv", "part", "seq"]
    behind = Cut(cells.mapInArrow(matrices, "conv string, part int, seq int, cells array<long>").groupBy("conv").applyInArrow(costs_behind, "conv string, part int, seq int, behind array<long>, last boolean"), "repair-costs").df
    known = cells.join(behind, place).select(*place, "codes", "behind", "last")
    entry = known.mapInArrow(moves, "conv string, part int, seq int, moves array<long>").groupBy("conv").applyInArrow(entries, "conv string, part int, seq int, entry int")
    return blocks.join(behind, place).join(entry, place)


def _traced(blocks: DataFrame, whole: bool) -> DataFrame:
    """The columns of the result, of each block; whole: blocks are whole conversations. Otherwise with the place of the
    block, the repaired text and what is needed to put blocks together."""
    names = ["conv_id", "first_turn", "last_turn", "turns", "illegal", "codes", "roles", "texts", "entry", "behind", "last", "conv", "part", "seq"]
    numbers = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    kind = blocks.schema["conv_id"].dataType.simpleString()
    turn = blocks.schema["first_turn"].dataType.simpleString()
    schema = f"conv_id {kind}, gaps long, {numbers}, repaired_sha256 string" if whole else f"conv_id {kind}, {numbers}, conv string, part int, seq int, first_turn {turn}, last_turn {turn}, turns long, first_role string, last_role string, repaired string"
    columns = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv_id, first, last_turn, turns, illegal, codes, roles, texts, entry, behind, last, conv, part, seq = batch.columns
            codes = codes.to_pylist()
            behind, entry, last = np.array(behind.to_pylist(), np.int64).reshape(-1, 4), entry.to_numpy(), last.to_numpy(zero_copy_only=False)
            n = len(codes)
            audit, cost, after = [b""] * n, np.zeros(n, np.int64), [np.zeros(0, np.uint8)] * n
            for some, tensor in tensors(codes, behind):
                edits, states, end = tensor.trace(entry[some], last[some])
                spent = tensor.costs[0, np.arange(len(some)), entry[some]] - np.where(last[some], 0, behind[some, end])
                for k, i in enumerate(some.tolist()):
                    audit[i], after[i], cost[i] = edits[k], states[k], spent[k]
            faults = [np.bincount(np.frombuffer(c, np.uint8) & 3, minlength=4) for c in codes]
            made = ["\n".join(repaired_lines(audit[i], after[i], roles[i].as_py(), texts[i].as_py())) for i in range(n)]
            found = [pa.array([int(f[k]) for f in faults], pa.int64()) for k in (BLANK_ROW, REPEATED_ROW, TRUNCATED_ROW)]
            found += [illegal, pa.array(cost), pa.array([a.decode() for a in audit], pa.string())]
            if whole:
                gaps = [0 if a is None else int(z - a) + 1 - d for a, z, d in zip(first.to_pylist(), last_turn.to_pylist(), turns.to_pylist(), strict=True)]
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in made]
                out = [conv_id, pa.array(gaps, pa.int64()), *found, pa.array(digests, pa.string())]
            else:
                # a block without repaired messages gives null: it adds no line
                ends = [pa.array([r.as_py()[k] if len(r) else None for r in roles], pa.string()) for k in (0, -1)]
                lines = [x if any(e != 68 for e in audit[i]) else None for i, x in enumerate(made)]
                out = [conv_id, *found, conv, part, seq, first, last_turn, turns, *ends, pa.array(lines, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=columns)
        release_memory()

    return blocks.select(*names).mapInArrow(run, schema)


def _joined(pieces: DataFrame, result: T.StructType) -> DataFrame:
    """Conversations from their traced blocks, which are read in order, one after the other."""
    ordered = pieces.repartition("conv").sortWithinPartitions("conv", "part", "seq")
    sums = ("blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def row() -> pa.RecordBatch:
            gaps = 0 if now["first"] is None else int(now["last"] - now["first"]) + 1 - now["turns"]
            values = [now["conv_id"], gaps, *(now[k] for k in sums), "".join(now["audit"]), now["digest"].hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=result.names)

        for batch in batches:
            types = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for i in range(batch.num_rows):
                b = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                if now is None or b["conv"] != now["conv"]:
                    if now is not None:
                        yield row()
                    now = {"conv": b["conv"], "conv_id": b["conv_id"], "first": None, "last": None, "turns": 0, "role": None, "audit": [], "digest": hashlib.sha256(), "lines": False} | dict.fromkeys(sums, 0)
                for k in sums:
                    now[k] += b[k]
                if now["role"] is not None and b["first_role"] is not None and not lawful(now["role"], b["first_role"]):
                    now["illegal"] += 1
                now["role"] = b["last_role"] if b["last_role"] is not None else now["role"]
                if b["first_turn"] is not None:
                    now["turns"] += b["turns"] - (b["first_turn"] == now["last"])
                    now["first"], now["last"] = b["first_turn"] if now["first"] is None else now["first"], b["last_turn"]
                now["audit"].append(b["audit"])
                if b["repaired"] is not None:
                    now["digest"].update((("\n" if now["lines"] else "") + b["repaired"]).encode())
                    now["lines"] = True
        if now is not None:
            yield row()

    return ordered.mapInArrow(run, result)


def repair(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    Rows are taken by turn, nulls first, then by role and text. times: a column that says how often a row counts, side
    by side; a conversation all of whose rows count 0 times gives zeros, an empty audit and the hash of ''. A row's first
    fault counts: blank (nothing but ASCII blanks), duplicate (role and text have been there before), truncated (the last
    character that is no blank is none of ``.!?``). gaps: turns that are missing between the first and the last.
    illegal: neighbours whose roles' first letters are not su, ua or au. Edits: K keeps a row, R gives it the role user or
    assistant (1), D deletes it (2; blank and duplicate rows must go), I inserts an empty message of user or assistant
    (5); a truncated row that stays costs 5 more. The edits are the cheapest that leave nothing, or pairs of user and
    assistant behind a system message or none, by first letters of roles; of equally cheap ones the least
    audit. An empty role has no letter and can't be kept.

    Null conversations are one; null roles and texts are one blank. Repeated rows count as they stand. An empty table
    gives no row. Other columns are not read. Only the audit of a conversation, a value of the result, and the
    digest of its text, which has to be read in order, pass through one task; memory is bounded by a block and the audit.
    """
    blank = F.lit(" ")
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), blank).alias("role"), F.coalesce(F.col(text).cast("string"), blank).alias("text"), (F.lit(1) if times is None else F.col(times)).cast("int").alias("times"))
    name: Column = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    blocks = Cut(_blocks(rows).withColumn("conv", name), "conversation-blocks").df
    several = Cut(blocks.filter("cut").groupBy("conv").agg(F.count("*").alias("n")).filter("n > 1").select("conv"), "long-conversations").df
    end = F.array(*(F.lit(int(x)).cast("long") for x in END))
    single = blocks.join(several, "conv", "left_anti").withColumns({"entry": F.lit(0), "behind": end, "last": F.lit(True)})
    done = _traced(single, True)
    parts = blocks.filter("cut").join(several, "conv", "left_semi")
    again = _repeats(parts)
    marked = parts.join(again, ["conv", "part", "seq"], "left")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for row in batch.to_pylist():
                own = bytearray(row["codes"])
                seen = {((x["high"] & (1 << 64) - 1) << 64) + (x["low"] & (1 << 64) - 1) for x in row["again"] or ()}
                for i, (r, t) in enumerate(zip(row["roles"], row["texts"], strict=True)) if seen else ():
                    if own[i] & 3 in (0, TRUNCATED_ROW) and _hashes(r, t) in seen:
                        own[i] = own[i] & ~3 | REPEATED_ROW
                codes.append(bytes(own))
            yield batch.drop_columns(["again"]).set_column(names.index("codes"), "codes", pa.array(codes, pa.binary()))

    names = parts.columns
    patched = Cut(marked.select(*names, "again").mapInArrow(mark, parts.schema), "repair-blocks").df
    return done.unionByName(_joined(_traced(_chained(patched), False), done.schema))


#: DuckDB SQL for op13 over conversations: costs are filled from the last row back, then edits are followed.
ORACLE = r"""
WITH RECURSIVE keyed AS (
  SELECT *, list_reduce([4294967295] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS inverse
  FROM conversations),
hit AS (SELECT conv_id, turn, xor(inverse, 4294967295) % 20 AS how, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM keyed),
hurt AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
         CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE how WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hit WHERE how <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid
  FROM hurt),
marked AS (
  SELECT *, substr(role, 1, 1) AS kind,
         CASE WHEN solid = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd'
              WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         coalesce(substr(lag(role) OVER (PARTITION BY conv_id ORDER BY k), 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM placed),
sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM marked GROUP BY conv_id),
priced AS (
  SELECT conv_id, k, kind, CASE WHEN fault IN ('b', 'd') THEN 1000000000000 WHEN fault = 't' THEN 5 ELSE 0 END AS more FROM marked),
costs AS (
  SELECT conv_id, n + 1 AS k, CAST(0 AS BIGINT) AS c0, CAST(10 AS BIGINT) AS c1, CAST(5 AS BIGINT) AS c2, CAST(0 AS BIGINT) AS c3 FROM sums
  UNION ALL
  SELECT conv_id, k, least(a0, 5 + least(a2, 5 + a3)), least(a1, 5 + least(a2, 5 + a3)), least(a2, 5 + a3), least(a3, 5 + a2)
  FROM (SELECT c.conv_id, p.k,
          least(2 + c0, p.more + CASE kind WHEN 's' THEN c1 WHEN 'u' THEN c2 ELSE 1000000000000 END, p.more + 1 + c2) AS a0,
          least(2 + c1, p.more + CASE kind WHEN 'u' THEN c2 ELSE 1000000000000 END, p.more + 1 + c2) AS a1,
          least(2 + c2, p.more + CASE kind WHEN 'a' THEN c3 ELSE 1000000000000 END, p.more + 1 + c3) AS a2,
          least(2 + c3, p.more + CASE kind WHEN 'u' THEN c2 ELSE 1000000000000 END, p.more + 1 + c2) AS a3
        FROM costs c JOIN priced p ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.k = c.k - 1)),
tables AS (SELECT conv_id, k, [c0, c1, c2, c3] AS c FROM costs),
steps AS (
  SELECT t.conv_id, t.k, t.c, u.c AS after, m.kind, m.role, m.text, p.more
  FROM tables t LEFT JOIN tables u ON t.conv_id IS NOT DISTINCT FROM u.conv_id AND u.k = t.k + 1
  LEFT JOIN marked m ON t.conv_id IS NOT DISTINCT FROM m.conv_id AND m.k = t.k
  LEFT JOIN priced p ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND p.k = t.k),
walk AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS k, 0 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM sums
  UNION ALL
  SELECT conv_id, CASE e WHEN 'I' THEN k ELSE k + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN (CASE kind WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END) ELSE to_ END, audit || e,
         CASE e WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, CASE to_ WHEN 2 THEN 'user:' ELSE 'assistant:' END) WHEN 'K' THEN list_append(lines, role || ':' || text)
                ELSE list_append(lines, CASE to_ WHEN 2 THEN 'user:' ELSE 'assistant:' END || text) END
  FROM (SELECT w.*, x.kind, x.role, x.text, CASE w.s WHEN 2 THEN 3 ELSE 2 END AS to_,
          CASE WHEN x.after IS NULL THEN 'I'
               WHEN x.c[w.s + 1] = 2 + x.after[w.s + 1] THEN 'D'
               WHEN x.c[w.s + 1] = 5 + x.c[CASE w.s WHEN 2 THEN 4 ELSE 3 END] THEN 'I'
               WHEN (x.kind = 's' AND w.s = 0 AND x.c[w.s + 1] = x.more + x.after[2]) OR (x.kind = 'u' AND w.s <> 2 AND x.c[w.s + 1] = x.more + x.after[3])
                 OR (x.kind = 'a' AND w.s = 2 AND x.c[w.s + 1] = x.more + x.after[4]) THEN 'K'
               ELSE 'R' END AS e
        FROM walk w JOIN steps x ON w.conv_id IS NOT DISTINCT FROM x.conv_id AND w.k = x.k
        WHERE x.after IS NOT NULL OR w.s IN (1, 2))),
ends AS (SELECT w.conv_id, w.audit, w.lines FROM walk w JOIN sums z ON w.conv_id IS NOT DISTINCT FROM z.conv_id WHERE w.k = z.n + 1 AND w.s IN (0, 3)),
all_of AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(z.gaps, 0) AS gaps, coalesce(z.blank, 0) AS blank, coalesce(z.duplicate, 0) AS duplicate, coalesce(z.truncated, 0) AS truncated,
       coalesce(z.illegal, 0) AS illegal, coalesce(t.c[1], 0) AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.lines, chr(10)), '')) AS repaired_sha256
FROM all_of a LEFT JOIN sums z ON a.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN ends e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN tables t ON a.conv_id IS NOT DISTINCT FROM t.conv_id AND t.k = 1
"""
