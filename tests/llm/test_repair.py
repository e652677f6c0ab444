"""Conversation repair against an enumeration of edits, one after the other."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from panelforge.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def by_enumeration(rows):
    """rows: (initial, gone, truncated). All edits with up to three insertions in a gap."""
    best = None
    edits = [["D"] if gone else ["K", "D", "Ru", "Ra"] for _, gone, _ in rows]
    gaps = ["".join(c) for m in range(4) for c in itertools.product("ua", repeat=m)]
    for chosen in itertools.product(*edits):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            said, audit, cost = put[0], "I" * len(put[0]), 3 * len(put[0])
            for (i, _, truncated), e, more in zip(rows, chosen, put[1:], strict=True):
                audit += e[0] + "I" * len(more)
                said += ("" if e == "D" else i if e == "K" else e[1]) + more
                cost += {"K": 0, "R": 3, "D": 4}[e[0]] + 3 * (truncated and e != "D") + 3 * len(more)
            if LEGAL.fullmatch(said) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def by_steps(rows):
    """The same for any number of rows, from left to right over places in the order of roles."""
    inserts = lambda at: [(c, a + "I", q) for c, a, q in [(3, "", q) for q in ((2,) if at != 2 else (3,))]]
    best = {0: (0, "")}
    for step in [*rows, None]:
        for _ in range(3):
            for p, (c, a) in list(best.items()):
                for dc, da, q in inserts(p):
                    best[q] = min(best.get(q, (9e9, "")), (c + dc, a + da))
        if step is None:
            return min(best[q] for q in (0, 3) if q in best)
        i, gone, truncated = step
        then = {}
        for p, (c, a) in best.items():
            ways = [(p, 4, "D")]
            if not gone:
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((i, p))
                ways += [(to, 3 * truncated, "K")] if to else []
                ways += [(3 if p == 2 else 2, 3 + 3 * truncated, "R")]
            for q, dc, da in ways:
                then[q] = min(then.get(q, (9e9, "")), (c + dc, a + da))
        best = then


def whole(rows, damage):
    """The contract over (conv_id, turn, role, text), row by row."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        held = convs[conv]
        role, text = role if role is not None else " ", text if text is not None else " "
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        held += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    out = {}
    for conv, held in convs.items():
        told = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), told(r)))
        seen, faults = set(), []
        for _, role, text in held:
            bare = text.rstrip(repair.SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = by_steps([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(held, faults, strict=True)])
        said, place, at = [], 0, 0
        for e in audit:
            if e == "K":
                role, text = held[at][1:]
            elif e in "RI":
                role, text = ("assistant" if place == 2 else "user"), held[at][2] if e == "R" else ""
            if e != "D":
                said.append(f"{role}:{text}")
                place = {"s": 1, "u": 2, "a": 3}[role[0]]
            at += e != "I"
        turns = {r[0] for r in held} - {None}
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(held)]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


def check(spark, rows, damage, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", "1 as gone", "2 as conv", "'x' as digest", "3 as part")
    got = repair.repair_conversations(df, damage).collect()
    assert len(got) == len({r.conv_id for r in got})
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got} == whole(rows, damage)


def test_cells_equal_an_enumeration_of_edits():
    rng = random.Random(3)
    cases = [[(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)] for n in (0, 1, 2) for _ in range(12)]
    for rows in cases:
        got = repair.least(repair.parse([repair.row_cell(*r) for r in rows]))
        assert got == by_enumeration(rows) == by_steps(rows), rows


def test_charts_of_any_cut_agree():
    rng = random.Random(4)
    for n in (1, 5, 15, 16, 17, 40, 300):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
        spans = repair.Spans()
        for r in rows:
            spans.add(repair.row_cell(*r))
        assert repair.least(spans.cell()) == by_steps(rows)
        if n <= 40:
            assert repair.least(repair.parse([repair.row_cell(*r) for r in rows])) == by_steps(rows)


@pytest.mark.parametrize("damage", [True, False])
def test_random_conversations(spark, damage):
    rng = random.Random(5)
    texts = ["Hi.", "No end", "", "  ", "\x0b", "Stop!\n", "Who?", None, "Ünï. \t", "a.b", "word " * 20_000 + "."]
    rows = [
        (rng.choice([None, -3, *range(40)]), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "usher"]), rng.choice(texts))
        for _ in range(400)
    ]
    rows += rows[:60]
    check(spark, rows, damage, extra=True)


def test_one_long_conversation_is_parsed_in_parts(spark):
    rng = random.Random(6)
    rows = [(7, t, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ("user", "assistant")[t % 2], f"Text {rng.randrange(1500)}.") for t in range(3000)]
    check(spark, rows, True)


def test_no_rows_and_dropped_conversations(spark):
    assert repair.repair_conversations(spark.createDataFrame([], SCHEMA), True).count() == 0
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    check(spark, [(c, 0, "user", "Hi.") for c in gone], True)
