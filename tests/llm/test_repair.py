import hashlib
import heapq
import random
import re
import zlib

import pytest

from sigwright.llm import repair
from sigwright.llm.queries import ORACLES, QUERIES
from sigwright.runtime import table

from oracle import same_rows

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    """{conv: [(turn, role, text)]} by the rule, in order."""
    out = {}
    for conv, turn, role, text in rows:
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1))
    for rows_of in out.values():
        rows_of.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def plain_faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        solid = text.strip(BLANKS)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_edits(rows, faults):
    """(cost, audit, lines) by a search over whole edit sequences, cheapest and then least first."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, lines = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, list(lines)
        if (at, last) in done:
            continue
        done.add((at, last))
        for new, name in names.items():
            if (last, new) in step:
                heapq.heappush(heap, (cost + 5, audit + "I", at, new, (*lines, f"{name}:")))
        if at == len(rows):
            continue
        _, role, text = rows[at]
        heapq.heappush(heap, (cost + 2, audit + "D", at + 1, last, lines))
        if faults[at] in ("blank", "duplicate"):
            continue
        more = 5 if faults[at] == "truncated" else 0
        if role and (last, role[0]) in step:
            heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[0], (*lines, f"{role}:{text}")))
        for new, name in names.items():
            if (last, new) in step:
                heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, new, (*lines, f"{name}:{text}")))
    raise AssertionError


def plain(damaged):
    out = []
    for conv, rows in damaged.items():
        faults = plain_faults(rows)
        cost, audit, lines = plain_edits(rows, faults)
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))  # noqa: B905
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def by_conv(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0))


def conversations(n, seed, most=12, texts=("Hi.", "so", "a b?", "x!", "", " \t", "well\x0b", "End.\n", None, "é…", "two\nlines.")):
    r = random.Random(seed)
    return [(c if c % 17 else None, r.choice([None, *range(most)]) if r.random() < 0.1 else t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "sys", None, "", "Assistant"]), r.choice(texts)) for c in range(n) for t in range(r.randint(1, most))]


def test_equals_a_search_over_edits(spark):
    rows = conversations(400, 1)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as conv", "1 as part", "2 as seq", "'y' as codes", "0 as times").repartition(3)
    got = repair.repair(repair.damaged(df), times="times").collect()
    assert by_conv(got) == by_conv(plain(plain_damage(rows)))
    assert {r.conv_id for r in got} == {r[0] for r in rows}


def test_blocks_change_nothing(spark, monkeypatch):
    rows = conversations(60, 2, 14) + [(7, i // 3, random.Random(i).choice(["user", "assistant", "system"]), random.Random(i + 1).choice(["Hi.", f"{i % 40}!", "so", f"{i}"])) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = by_conv(plain(plain_damage(rows)))
    for name, value in (("BLOCK_ROWS", 3), ("BLOCK_BYTES", 9)):
        with monkeypatch.context() as m:
            m.setattr(repair, name, value)
            assert by_conv(repair.repair(repair.damaged(df), times="times").collect()) == want


def test_a_conversation_of_a_third_of_all_rows_is_many_blocks(spark):
    texts = [f"line {i}{'.' if i % 5 else ''}" for i in range(6000)] + ["same."] * 3000
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)] + [(1000 + i, 0, "user", "Hi.") for i in range(18000)]
    got = repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(8)).filter("conv_id = 1").collect()
    one = [(i, r, t) for _, i, r, t in rows[:9000]]
    faults = plain_faults(one)
    assert (got[0].duplicate, got[0].truncated, got[0].gaps, got[0].illegal) == (faults.count("duplicate"), faults.count("truncated"), 0, 0)
    assert len(got[0].audit.replace("I", "")) == 9000
    cells = [x[2] for x in one]
    # replay: what the audit makes is lawful, and its cost and digest are those stated
    cost, last, at, lines = 0, "", 0, []
    for e in got[0].audit:
        if e == "I":
            last = "a" if last == "u" else "u"
            lines.append({"u": "user:", "a": "assistant:"}[last])
            cost += 5
            continue
        if e == "D":
            cost += 2
        else:
            cost += (e == "R") + 5 * (faults[at] == "truncated")
            new = one[at][1][0] if e == "K" else "a" if last == "u" else "u"
            assert faults[at] in ("", "truncated") and (last, new) in {("", "u"), ("u", "a"), ("a", "u")}
            lines.append(f"{'user' if new == 'u' else 'assistant'}:{cells[at]}")
            last = new
        at += 1
    assert cost == got[0].cost and last in ("", "a")
    assert got[0].repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(None, None, "user", "a.")] * 3])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert by_conv(repair.repair(repair.damaged(df), times="times").collect()) == by_conv(plain(plain_damage(rows)))


def test_whole_table(spark, small):
    rows = [tuple(r) for r in table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_repair"](spark, small)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert by_conv(got.collect()) == by_conv(plain(plain_damage(rows)))
    same_rows(got, ORACLES["op13_repair"], small)


def test_sql_of_odd_rows(spark, tmp_path):
    df = spark.createDataFrame(conversations(300, 5), SCHEMA)
    df.coalesce(1).write.parquet(f"{tmp_path}/raw")
    (part,) = tmp_path.glob("raw/*.parquet")
    part.rename(tmp_path / "conversations.parquet")
    same_rows(QUERIES["op13_repair"](spark, str(tmp_path)), ORACLES["op13_repair"], str(tmp_path))
