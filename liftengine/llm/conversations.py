"""Finding faults in conversations and repairing their structure at least cost.

A conversation's rows, in order of turn, are edited until their roles read as an optional
system turn and then user and assistant by turns.  Each edit costs something and leaves a
letter in the audit; the cheapest edits are taken, and of equally cheap ones those whose
audit comes first.

A way through the edits is weighed by one integer: its high digits are the cost, below them
comes a base-256 digit for every possible letter of the audit, unused ones at the end being
zero, and the lowest digits count the letters so far.  Adding an edit is an addition, and the
smallest integer among the ways to a (row, role) node is the way to keep.  Nothing else
decides.  Ways to one node that cost the same never have audits of which one begins the
other, as it would then have further insertions to pay for, so what follows cannot turn the
order round.

Rows are sorted by conversation over all tasks in ranges of equal size and cut into blocks
of bounded size, so a conversation of any length is shared out.  One that lies in a single
block, as nearly all do, is finished there.  Of the others every block yields the best way
from each role to each role; these are joined up in groups of ``FAN`` until one is left.  The
audit then goes back to the blocks, which write out their repaired turns.  What one task holds
of a conversation is a block, or its audit (a byte per row, which is a single value of the
result).

Defined cases: NULL role or text is one space, so such a text is blank.  Rows without a turn
come first.  Rows of one turn are ordered by the first characters of role and text, then by a
hash of both; equal rows are interchangeable.  NULL is a conversation of its own.  A
conversation whose rows are all gone has zeros, an empty audit and an empty text.  An empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import sys
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftengine.llm.common import SPACE
from liftengine.sources.scratch import write_scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 256
BLOCK_CHARS = 1 << 20
FAN = 64

# roles so far: nothing, a system turn, a user turn last, an assistant turn last
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
LEGAL = {"su", "ua", "au"}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT = (ord(letter) for letter in "KRDI")
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SUMMARY = ("n bigint, turns bigint, low bigint, high bigint, first string, last string, "
            "blank bigint, duplicate bigint, truncated bigint, illegal bigint")
_CELLS = "cells array<struct<enter:int,leave:int,cost:bigint,audit:string>>"
_BLOCKS = "blocks array<struct<part:int,block:int,n:bigint>>"


# --- the integer-minimum walk -----------------------------------------------------

class Weights:
    """Integers for ways with at most ``letters`` edits."""

    COUNT = 32

    def __init__(self, letters: int):
        self.letters = letters
        self.high = self.COUNT + 8 * letters

    def add(self, weight: int, cost: int, letter: int) -> int:
        at = weight & ((1 << self.COUNT) - 1)
        digit = letter << (self.COUNT + 8 * (self.letters - 1 - at))
        return weight + (cost << self.high) + digit + 1

    def pack(self, cost: int, audit: str) -> int:
        digits = int.from_bytes(audit.encode().ljust(self.letters, b"\0"), "big")
        return (cost << self.high) | (digits << self.COUNT) | len(audit)

    def unpack(self, weight: int) -> tuple[int, str]:
        digits = (weight >> self.COUNT) & ((1 << 8 * self.letters) - 1)
        audit = digits.to_bytes(self.letters, "big").rstrip(b"\0").decode()
        return weight >> self.high, audit


def _offer(ways, state, weight):
    if ways[state] is None or weight < ways[state]:
        ways[state] = weight


def _with_insertions(ways, own):
    """Ways with up to two turns inserted; a third would only lead back to the same role."""
    best, reached = list(ways), ways
    for _ in range(2):
        further = [None] * 4
        for state, weight in enumerate(reached):
            if weight is not None:
                for role in NEXT[state].keys() & {"u", "a"}:
                    _offer(further, NEXT[state][role], own.add(weight, COST[INSERT], INSERT))
        for state, weight in enumerate(further):
            if weight is not None:
                _offer(best, state, weight)
        reached = further
    return best


def walk(roles, faults, enter: int) -> dict[int, tuple[int, str]]:
    """The best way over the rows from role ``enter`` to each role: {role: (cost, audit)}."""
    own = Weights(3 * len(roles))
    ways = [None] * 4
    ways[enter] = 0
    for role, fault in zip(roles, faults):
        before, ways = _with_insertions(ways, own), [None] * 4
        extra = int(fault == TRUNCATED)
        for state, weight in enumerate(before):
            if weight is None:
                continue
            _offer(ways, state, own.add(weight, COST[DELETE], DELETE))
            if fault in (BLANK, DUPLICATE):
                continue
            if role[:1] in NEXT[state]:
                _offer(ways, NEXT[state][role[:1]], own.add(weight, COST[KEEP] + extra, KEEP))
            for other in NEXT[state].keys() & {"u", "a"}:
                _offer(ways, NEXT[state][other], own.add(weight, COST[REROLE] + extra, REROLE))
    return {state: own.unpack(w) for state, w in enumerate(ways) if w is not None}


def finish(leave: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The best way among those to any role, with the turns that are still missing."""
    own = Weights(max(len(audit) for _, audit in leave.values()) + 2)
    ways = [None] * 4
    for state, way in leave.items():
        ways[state] = own.pack(*way)
    ends = _with_insertions(ways, own)
    return own.unpack(min(w for w in (ends[START], ends[ASSISTANT]) if w is not None))


def join_cells(left: dict, right: dict) -> dict:
    """Best ways over two stretches in a row, from the best ways over each."""
    found: dict = {}
    for (enter, middle), (cost, audit) in left.items():
        for (start, leave), (more, rest) in right.items():
            if start == middle:
                found.setdefault((enter, leave), []).append((cost + more, audit + rest))
    own = Weights(max((len(a) for ways in found.values() for _, a in ways), default=0))
    return {ends: own.unpack(min(own.pack(*way) for way in ways))
            for ends, ways in found.items()}


def apply_edits(audit: str, state: int, roles, texts) -> tuple[list[str], int]:
    """The repaired turns as ``role:text``, and the role they end with."""
    out, at = [], 0
    for letter in audit.encode():
        if letter != INSERT:
            role, text = roles[at], texts[at]
            at += 1
        if letter == DELETE:
            continue
        if letter in (INSERT, REROLE):
            role = "assistant" if state == USER else "user"
        out.append(f"{role}:{'' if letter == INSERT else text}")
        state = NEXT[state][role[:1]]
    return out, state


def fault_of(text: str) -> int:
    bare = text.strip(SPACE)
    if not bare:
        return BLANK
    return FINE if bare[-1] in ".!?" else TRUNCATED


class Block:
    """Consecutive rows of one conversation."""

    def __init__(self, roles, texts, faults, turns):
        self.roles, self.texts, self.faults, self.turns = roles, texts, faults, turns

    @classmethod
    def of(cls, rows):
        roles, texts, faults, turns, seen = [], [], [], [], set()
        for turn, role, text in rows:
            fault = fault_of(text)
            if fault != BLANK and (role, text) in seen:
                fault = DUPLICATE
            seen.add((role, text))
            roles.append(role)
            texts.append(text)
            faults.append(fault)
            turns.append(turn)
        return cls(roles, texts, faults, turns)

    def digests(self):
        """Of every row that may repeat one of an earlier block; else None."""
        return [None if fault in (BLANK, DUPLICATE) else
                hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
                for role, text, fault in zip(self.roles, self.texts, self.faults)]

    def summary(self) -> dict:
        known = [t for t in self.turns if t is not None]
        initials = [role[:1] for role in self.roles]
        return {
            "n": len(self.roles), "turns": len(set(known)),
            "low": min(known, default=None), "high": max(known, default=None),
            "first": initials[0] if initials else None,
            "last": initials[-1] if initials else None,
            "blank": self.faults.count(BLANK), "duplicate": self.faults.count(DUPLICATE),
            "truncated": self.faults.count(TRUNCATED),
            "illegal": sum(a + b not in LEGAL for a, b in pairwise(initials)),
        }


def join_summaries(a: dict, b: dict) -> dict:
    if not a["n"] or not b["n"]:
        return b if not a["n"] else a
    out = {k: a[k] + b[k] for k in (
        "n", "turns", "blank", "duplicate", "truncated", "illegal")}
    if a["high"] is not None and a["high"] == b["low"]:
        out["turns"] -= 1
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    return out | {
        "low": a["low"] if a["low"] is not None else b["low"],
        "high": b["high"] if b["high"] is not None else a["high"],
        "first": a["first"], "last": b["last"]}


def _gaps(s: dict) -> int:
    return 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]


# --- over a table -----------------------------------------------------------------

def damage(rows: DataFrame) -> DataFrame:
    """Faults dealt out by a checksum of conversation and turn; ``gone`` marks dropped rows."""
    def plain(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn"))) % 20
    dealt = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"),
                        plain("role").alias("role"), plain("text").alias("text"),
                        kind.alias("kind"))
    twice = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return dealt.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(
            F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"), F.explode(twice).alias("copy")).drop("copy")


def _batch(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _in_batches(schema, rows, size=512, chars=4 << 20):
    held, weight = [], 0
    for row, long in rows:
        held.append(row)
        weight += long
        if len(held) >= size or weight >= chars:
            yield _batch(schema, held)
            held, weight = [], 0
    if held:
        yield _batch(schema, held)


def _cut(rows: DataFrame, block_rows: int, block_chars: int) -> DataFrame:
    """Blocks of sorted rows; a conversation wholly in one block comes with its result."""
    spark = rows.sparkSession
    key = rows.schema["conv_id"].dataType.simpleString()
    ddl = (f"conv_id {key}, part int, block int, open boolean, "
           + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired string, "
           "roles array<string>, texts array<string>, faults array<int>, "
           "row_turns array<bigint>, digests array<binary>")
    schema = _arrow(spark, ddl)

    def blocks(batches):
        part = TaskContext.get().partitionId()
        runs, number, held, chars, conv, any_row = 0, 0, [], 0, None, False

        def made(is_open):
            block = Block.of(held)
            row = {"conv_id": conv, "part": part, "block": number, "open": is_open}
            if is_open:
                row |= {"roles": block.roles, "texts": block.texts, "faults": block.faults,
                        "row_turns": block.turns, "digests": block.digests()}
            else:
                cost, audit = finish(walk(block.roles, block.faults, START))
                turns, _ = apply_edits(audit, START, block.roles, block.texts)
                told = block.summary()
                row |= {"gaps": _gaps(told), "cost": cost, "audit": audit,
                        "repaired": "\n".join(turns), **{c: told[c] for c in COUNTS[1:5]}}
            return row, chars

        split = False
        for batch in batches:
            columns = [batch.column(c).to_pylist()
                       for c in ("conv_id", "turn", "role", "text", "gone")]
            for own, turn, role, text, gone in zip(*columns):
                if any_row and own != conv:
                    # the first conversation may go on from the range before
                    yield made(split or runs == 0)
                    runs, number, held, chars, split = runs + 1, number + 1, [], 0, False
                conv, any_row = own, True
                if gone:
                    continue
                if held and (len(held) >= block_rows or chars + len(text) > block_chars):
                    yield made(True)
                    number, held, chars, split = number + 1, [], 0, True
                held.append((turn, role, text))
                chars += len(text)
        if any_row:
            yield made(True)  # and the last may go on in the range behind

    order = [F.substring("role", 1, 16), F.substring("text", 1, 64), F.xxhash64("role", "text")]
    keyed = rows.select(
        "conv_id", "turn", "role", "text", "gone",
        *[c.alias(f"k{i}") for i, c in enumerate(order)],
        F.monotonically_increasing_id().alias("k3"))
    keys = ("conv_id", "turn", "k0", "k1", "k2", "k3")
    ordered = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "conv_id", "turn", "role", "text", "gone")
    return ordered.mapInArrow(lambda batches: _in_batches(schema, blocks(batches)), ddl)


def _marked(shared: DataFrame) -> DataFrame:
    """Open blocks with ``again``: places of rows that repeat one of an earlier block."""
    at = shared.select("conv_id", "part", "block", F.posexplode("digests").alias("at", "digest"))
    order = Window.partitionBy("conv_id", "digest").orderBy("part", "block")
    again = at.where("digest is not null").withColumn("nth", F.row_number().over(order)).where(
        "nth > 1").groupBy("part", "block").agg(F.collect_list("at").alias("again"))
    return shared.join(again, ["part", "block"], "left")


def _block(row: dict) -> Block:
    faults = list(row["faults"])
    for at in row["again"] or ():
        faults[at] = DUPLICATE
    return Block(row["roles"], row["texts"], faults, row["row_turns"])


def _weigh(marked: DataFrame, key: str) -> DataFrame:
    ddl = f"conv_id {key}, part int, block int, {_SUMMARY}, {_CELLS}"
    schema = _arrow(marked.sparkSession, ddl)

    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = _block(row)
                cells = [{"enter": enter, "leave": leave, "cost": cost, "audit": audit}
                         for enter in range(4)
                         for leave, (cost, audit) in walk(block.roles, block.faults, enter).items()]
                yield {"conv_id": row["conv_id"], "part": row["part"], "block": row["block"],
                       **block.summary(), "cells": cells}, 16 * len(block.roles)

    return marked.mapInArrow(lambda batches: _in_batches(schema, rows(batches)), ddl)


def _fold(weighed: DataFrame, top: int, key: str, fan: int) -> DataFrame:
    """One row per conversation from its numbered blocks."""
    ddl = f"conv_id {key}, seq bigint, {_SUMMARY}, {_CELLS}, {_BLOCKS}"
    schema = _arrow(weighed.sparkSession, ddl)

    def joined(table: pa.Table) -> pa.Table:
        total = None
        for row in sorted(table.to_pylist(), key=lambda r: r["seq"]):
            cells = {(c["enter"], c["leave"]): (c["cost"], c["audit"]) for c in row["cells"]}
            if total is None:
                total, ways = row, cells
                continue
            blocks = total["blocks"] + row["blocks"]
            total = total | join_summaries(total, row) | {"blocks": blocks}
            ways = join_cells(ways, cells)
        row = total | {"seq": total["seq"] // fan, "cells": [
            {"enter": a, "leave": b, "cost": cost, "audit": audit}
            for (a, b), (cost, audit) in ways.items()]}
        return pa.Table.from_pylist([{n: row[n] for n in schema.names}], schema)

    while top:
        weighed = write_scratch(
            weighed.groupBy("conv_id", F.floor(F.col("seq") / fan).alias("up")).applyInArrow(
                joined, ddl), "folded")
        top //= fan
    return weighed


def _results(folded: DataFrame, key: str) -> DataFrame:
    ddl = (f"conv_id {key}, " + ", ".join(f"{c} bigint" for c in COUNTS)
           + f", audit string, {_BLOCKS}")
    schema = _arrow(folded.sparkSession, ddl)

    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                cost, audit = finish({c["leave"]: (c["cost"], c["audit"])
                                      for c in row["cells"] if c["enter"] == START})
                yield {"conv_id": row["conv_id"], "gaps": _gaps(row), "cost": cost,
                       "audit": audit, "blocks": row["blocks"],
                       **{c: row[c] for c in COUNTS[1:5]}}, len(audit)

    return folded.mapInArrow(lambda batches: _in_batches(schema, rows(batches)), ddl)


def _state(turns: int, system: bool) -> int:
    """The role that so many turns of a repaired conversation end with."""
    if not turns:
        return START
    if system and turns == 1:
        return SYSTEM
    return USER if turns % 2 != system else ASSISTANT


def _slices(results: DataFrame) -> DataFrame:
    """Each block's part of its conversation's audit, and the role it starts from.

    Repaired turns are even in number unless a system turn leads them.
    """
    ddl = "part int, block int, piece bigint, pieces bigint, state int, slice string"
    schema = _arrow(results.sparkSession, ddl)

    def rows(batches):
        for batch in batches:
            for row in batch.select(["audit", "blocks"]).to_pylist():
                audit, blocks, at, turns = row["audit"], row["blocks"], 0, 0
                system = (len(audit) - audit.count("D")) % 2 == 1
                for nth, block in enumerate(blocks):
                    end, left = at, block["n"]
                    while left:
                        left -= audit[end] != "I"
                        end += 1
                    if nth == len(blocks) - 1:
                        end = len(audit)
                    yield {"part": block["part"], "block": block["block"], "piece": nth,
                           "pieces": len(blocks), "state": _state(turns, system),
                           "slice": audit[at:end]}, end - at
                    turns += end - at - audit.count("D", at, end)
                    at = end

    return results.mapInArrow(lambda batches: _in_batches(schema, rows(batches)), ddl)


def _pieces(marked: DataFrame, slices: DataFrame, key: str) -> DataFrame:
    ddl = f"conv_id {key}, piece bigint, pieces bigint, repaired string"
    schema = _arrow(marked.sparkSession, ddl)

    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                turns, _ = apply_edits(row["slice"], row["state"], row["roles"], row["texts"])
                text = "\n".join(turns)
                yield {"conv_id": row["conv_id"], "piece": row["piece"],
                       "pieces": row["pieces"], "repaired": text}, len(text)

    return marked.join(slices, ["part", "block"]).mapInArrow(
        lambda batches: _in_batches(schema, rows(batches)), ddl)


class Repaired:
    """``conversations``: conv_id, counts, cost, audit.  ``pieces``: the repaired turns as
    ``role:text`` lines in order of ``piece``; each conversation has ``pieces`` of them."""

    def __init__(self, conversations: DataFrame, pieces: DataFrame):
        self.conversations, self.pieces = conversations, pieces


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS,
           fan: int = FAN) -> Repaired:
    """Repair ``rows`` (conv_id, turn, role, text, and ``gone`` for rows that only make their
    conversation known)."""
    key = rows.schema["conv_id"].dataType.simpleString()
    cut = write_scratch(_cut(rows, block_rows, block_chars), "blocks")
    done, shared = cut.where("not open"), cut.where("open")
    marked = write_scratch(_marked(shared), "marked")
    weighed = write_scratch(_weigh(marked, key), "weights")
    order = Window.partitionBy("conv_id").orderBy("part", "block")
    numbers = weighed.select("part", "block", (F.row_number().over(order) - 1).cast(
        "bigint").alias("seq"))
    numbered = write_scratch(weighed.join(numbers, ["part", "block"]).withColumn(
        "blocks", F.array(F.struct("part", "block", "n"))).drop("part", "block"), "numbered")
    top = numbered.agg(F.max("seq")).first()[0] or 0
    results = write_scratch(_results(_fold(numbered, top, key, fan), key), "repaired")
    pieces = _pieces(marked, _slices(results), key)
    columns = ("conv_id", *COUNTS, "audit")
    return Repaired(
        done.select(*columns).unionByName(results.select(*columns)),
        done.select("conv_id", F.lit(0).cast("bigint").alias("piece"),
                    F.lit(1).cast("bigint").alias("pieces"), "repaired").unionByName(pieces))


def digests(pieces: DataFrame) -> DataFrame:
    """SHA-256 of every conversation's repaired turns, joined by newlines: conv_id, sha256.

    A conversation in many pieces is read through in order, a piece at a time.
    """
    key = pieces.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {key}, sha256 string"
    schema = _arrow(pieces.sparkSession, ddl)

    def rows(batches):
        digest, begun = hashlib.sha256(), False
        for batch in batches:
            for row in batch.to_pylist():
                if row["piece"] == 0:
                    digest, begun = hashlib.sha256(), False
                if row["repaired"]:
                    digest.update((b"\n" if begun else b"") + row["repaired"].encode())
                    begun = True
                if row["piece"] == row["pieces"] - 1:
                    yield {"conv_id": row["conv_id"], "sha256": digest.hexdigest()}, 64

    single = pieces.where("pieces = 1").select("conv_id", F.sha2("repaired", 256).alias("sha256"))
    several = pieces.where("pieces > 1").repartition("conv_id").sortWithinPartitions(
        "conv_id", "piece").select("conv_id", "piece", "pieces", "repaired")
    return single.unionByName(several.mapInArrow(
        lambda batches: _in_batches(schema, rows(batches)), ddl))
