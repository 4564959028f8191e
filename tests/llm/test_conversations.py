"""Conversation repair against an exhaustive search."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from auditlens.llm import conversations as C
from auditlens.llm.queries import op11_conversation_repair

ROWS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """The least (cost, audit) and its result, over all edits, by trying them."""
    best = None
    seen, faults = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        if not body:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    limit = 4 * len(rows) + 6

    def go(i, cost, audit, out, inserted):
        nonlocal best
        if cost > limit or (best and cost > best[0]):
            return
        if i == len(rows) and LEGAL.fullmatch("".join(r[:1] or "-" for r, _ in out)):
            best = min(best or (cost, audit, out), (cost, audit, out))
        if inserted <= len(rows) + 1:
            for role in ("user", "assistant"):
                if not out or out[-1][0][:1] != role[0]:
                    go(i, cost + 3, audit + "I", [*out, (role, "")], inserted + 1)
        if i < len(rows):
            go(i + 1, cost + 4, audit + "D", out, inserted)
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                role, text = rows[i]
                go(i + 1, cost + more, audit + "K", [*out, (role, text)], inserted)
                for other in ("user", "assistant"):
                    go(i + 1, cost + more + 3, audit + "R", [*out, (other, text)], inserted)

    go(0, 0, "", [], 0)
    return best, faults


def expected(conv_id, rows):
    """A row of the report; rows: (turn, role, text) after the damage, in order."""
    (cost, audit, out), faults = cheapest([r[1:] for r in rows])
    known = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    pairs = zip(initials, initials[1:], strict=False)
    return {
        "conv_id": conv_id,
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
        "blank": faults.count("blank"),
        "duplicate": faults.count("duplicate"),
        "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in pairs),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256(
            "\n".join(f"{r}:{t}" for r, t in out).encode()
        ).hexdigest(),
    }


def hurt(conv_id, rows):
    out = []
    for turn, role, text in rows:
        name = [" " if v is None else str(v) for v in (conv_id, turn)]
        case = zlib.crc32(":".join(name).encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        out += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def made(seed, longest=5):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["A.", "B!", "c", "d ", "", " \n", None, "E?\t", "A.", "F "]
    turns = [None, 0, 1, 2, 3, 4, 5, 9, 2, 10**12]
    return [
        (draw.choice(turns), draw.choice(roles), draw.choice(texts))
        for _ in range(draw.randrange(longest + 1))
    ]


def report(frame):
    return sorted((r.asDict() for r in frame.collect()), key=lambda r: str(r["conv_id"]))


@pytest.mark.parametrize("most_rows", [1, 2, 4096])
def test_equals_the_search(spark, written, most_rows):
    """Also where every conversation is cut into fragments of one or two rows."""
    made_up = {c: made(c) for c in range(150)} | {None: made(1000)}
    rows = [(c, *r, "x", 1) for c, turns in made_up.items() for r in turns]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, f"{ROWS}, audit string, cost int")
    found = report(C.repair_report(C.damaged(frame), written, most_rows=most_rows))
    want = [expected(c, hurt(c, turns)) for c, turns in made_up.items() if turns]
    assert found == sorted(want, key=lambda r: str(r["conv_id"]))


def test_undamaged_rows_can_be_repaired_too(spark, written):
    frame = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hm.")], ROWS)
    whole, parts = C.repaired(C.spoken(frame), written)
    rows = [r.asDict() for r in whole.select("audit", "cost").collect()]
    rows += [r.asDict() for r in parts.select("audit", "cost").collect()]
    # KIKI, KRs: reroling the second costs as much as one inserted turn
    assert rows == [{"audit": "KR", "cost": 3}]


def test_empty_table(spark, written):
    assert C.repair_report(C.damaged(spark.createDataFrame([], ROWS)), written).count() == 0


def test_one_very_long_conversation(spark, written):
    """It is dealt over tasks, and equals a left-to-right search with one state a place."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    draw = random.Random(5)
    rows = [
        (7, i // 3, draw.choice(["user", "assistant"]), draw.choice("abcdefgh") + draw.choice(".!?,"))
        for i in range(9000)
    ]
    frame = spark.createDataFrame(rows, ROWS)
    spoken = C.spoken(frame)
    tasks = C.in_order(spoken).select("task").distinct().count()
    assert tasks > 1
    (found,) = report(C.repair_report(spoken, written, most_rows=500))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ordered = sorted(rows, key=lambda r: (r[1], r[2], r[3]))
    seen, ways = set(), {p: c for (s, p), c in C.EMPTY.items() if s == C.START}
    for _, _, role, text in ordered:
        cells = C.leaf(role[:1], C.fault_of(role, text, (role, text) in seen))
        seen.add((role, text))
        nxt = {}
        for p, (cost, audit) in ways.items():
            for (a, q), (more, edit) in cells.items():
                if a == p:
                    way = (cost + more, audit + edit)
                    nxt[q] = min(nxt.get(q, way), way)
        ways = nxt
    assert (found["cost"], found["audit"]) == min(ways[q] for q in C.ACCEPTED if q in ways)
    assert found["duplicate"] == 9000 - len(seen) and found["gaps"] == 0


def test_whole_table(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    by_id = {}
    for r in frame.orderBy("conv_id", "turn").collect():
        by_id.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    found = report(op11_conversation_repair(spark, sf_dir))
    assert {r["conv_id"] for r in found} == set(by_id) and len(found) == len(by_id)
    short = {c: hurt(c, rows) for c, rows in by_id.items()}
    wanted = {c: expected(c, rows) for c, rows in short.items() if len(rows) <= 5}
    assert wanted and all(r == wanted[r["conv_id"]] for r in found if r["conv_id"] in wanted)
    assert frame.select(F.countDistinct("conv_id")).first()[0] == len(found)
