"""Repair of conversations next to a walk over all edits, tuple by tuple."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from liftengine.llm import conversations as C
from liftengine.llm import queries as Q

ROLES = re.compile(r"(s?(ua)+)?")
DDL = "conv_id bigint, turn bigint, role string, text string"
RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
          "repaired_sha256")


def faults_of(rows):
    out, seen = [], set()
    for _, role, text in rows:
        seen_before = (role, text) in seen
        seen.add((role, text))
        last = re.search(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)", text)
        out.append("blank" if not last else "duplicate" if seen_before else
                   "" if last[0] in ".!?" else "truncated")
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired turns) by exhaustive search with memory of suffixes."""
    roles = [r[1] for r in rows]

    @lru_cache(None)
    def best(at, state, inserted):
        ways = []
        if at == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))

        def go(cost, letter, role, text, taken):
            initial = role[:1]
            ok = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
            if len(initial) == 1 and initial in ok:
                more = best(at + taken, initial, 0 if taken else inserted + 1)
                if more:
                    ways.append((cost + more[0], letter + more[1], (f"{role}:{text}", *more[2])))

        if inserted < 3:
            for role in ("user", "assistant"):
                go(2, "I", role, "", 0)
        if at < len(rows):
            more = best(at + 1, state, 0)
            if more:
                ways.append((3 + more[0], "D" + more[1], more[2]))
            if faults[at] not in ("blank", "duplicate"):
                extra = faults[at] == "truncated"
                go(extra, "K", roles[at], rows[at][2], 1)
                for role in ("user", "assistant"):
                    go(2 + extra, "R", role, rows[at][2], 1)
        return min(ways, default=None)

    return best(0, "", 0)


def plain(table):
    """What the query must return, from rows (conv_id, turn, role, text)."""
    held = {}
    for conv, turn, role, text in table:
        rows = held.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        rows += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, rows in held.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults = faults_of(rows)
        known = [r[0] for r in rows if r[0] is not None]
        cost, audit, turns = cheapest(rows, faults)
        pairs = itertools.pairwise([r[1][:1] for r in rows])
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0,
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit,
            hashlib.sha256("\n".join(turns).encode()).hexdigest())
        assert ROLES.fullmatch("".join(t[0] for t in turns))
    return out


def run(spark, table, **how):
    made = C.repair(C.damage(spark.createDataFrame(table, DDL)), **how)
    hashed = {r[0]: r[1] for r in C.digests(made.pieces).collect()}
    rows = [r.asDict() for r in made.conversations.collect()]
    assert len(rows) == len(hashed)
    return {r["conv_id"]: (*[r[c] for c in RESULT[:-1]], hashed[r["conv_id"]]) for r in rows}


def invented(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            text = rng.choice(["Fine.", "So?", "cut off", " ", "", None, f"It is {turn}!",
                               f"no end {turn}", "Fine. \n", " "])
            rows.append((conv, turn + rng.choice([0, 0, 0, 5]) if rng.random() < .95 else None,
                         role, text))
    return list(dict(((r[0], r[1]), r) for r in rows).values())


def test_whole_table_against_all_edits(spark, medium):
    table = [tuple(r) for r in spark.read.parquet(f"{medium}/conversations.parquet").collect()]
    rows = Q.op11_conversations(spark, medium).collect()
    got = {r["conv_id"]: tuple(r[c] for c in RESULT) for r in rows}
    assert len(rows) == len(got) and got == plain(table)


@pytest.mark.parametrize("how", [{}, {"block_rows": 2, "fan": 2}, {"block_chars": 8, "fan": 3}])
def test_invented_conversations(spark, how):
    table = invented(5, 60, 9) + invented(7, 1, 400)
    table = [(900 if i >= len(table) - 300 else r[0], *r[1:]) for i, r in enumerate(table)]
    table = list({(r[0], r[1]): r for r in table}.values())
    assert run(spark, table, **how) == plain(table)


def test_defined_cases(spark):
    assert run(spark, []) == {}
    rows = [(None, None, None, None), (None, 1, "user", "Yes."), (None, 2, "assistant", "No."),
            (1, None, "user", None), (2, 5, "user", "a." * 200_000)] + [(3, 3, "user", "Hi.")] * 3
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, block_rows=1, fan=2) == plain(rows)


def test_all_rows_gone(spark):
    gone = next(i for i in range(10 ** 6) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = run(spark, [(gone, 0, "user", "Hi.")])
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_ties_take_the_least_audit():
    fine = [C.FINE] * 2
    assert C.finish(C.walk(["assistant", "user"], fine, C.START)) == (4, "IKKI")
    assert C.finish(C.walk(["user", "user"], fine, C.START)) == (2, "KR")
    assert C.finish(C.walk(["system"], [C.FINE], C.START)) == (3, "D")
    assert C.finish(C.walk(["assistant"], [C.BLANK], C.START)) == (3, "D")


def test_other_columns_are_not_read(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "So.")]
    odd = spark.createDataFrame(rows, DDL).selectExpr(
        "*", "'x' as gone", "1 as part", "2 as block", "3 as kind", "4 as copy")
    made = C.repair(C.damage(odd))
    assert [r["conv_id"] for r in made.conversations.collect()] == [1]
