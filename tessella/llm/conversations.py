"""Conversation structure repair: the cheapest edits that give every conversation its order of roles.

A conversation should read system?, then user and assistant in turn, and end with an
assistant's row (or be empty). Rows may be kept, given another role or deleted, and
rows of empty text inserted; among the cheapest scripts the one with the ASCII-least
audit string (the edits' initials in order) counts.

Rank-compressed dynamic programme. A layer is a row; a macro edit is a run of inserts and
the edit of the row, such as ``IK``. The macros' initials are a prefix-free code, so two
scripts up to the same layer compare as their macros do, in order. A layer therefore keeps,
for each state of the role order, the cost, a parent pointer (state, macro) and the *rank* of
its script among the states; no audit string is kept. Ranks and costs relative to the
least are few, so layers are memorised: a row costs one look-up. The script is read off
the parent pointers afterwards.

How it is spread: rows are sorted over all tasks by range of (conversation, turn, role, digest of
the text), so a task holds whole conversations and at most two that go on elsewhere. For
these it says what each state before its rows leads to behind them (4 x 4 costs, with ranks),
which is joined in order; so a conversation may hold any share of all rows. Its repaired
rows then pass through one task in order, in a stream, for their common digest.

Cases: null role or text is one space, and a null turn or conversation too where they are
part of the damage's key; null turns come first; rows of equal turn are ordered by role and digest
of the text; a null conv_id is a conversation like others; a role counts by its first
character; repeated rows are duplicates; a conversation without rows has zeros, an empty
audit and the digest of the empty string; an empty table gives an empty result; texts are
taken whole; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, group_join, shuffle_partitions

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANK_TEXT = r"[^\x20\x09-\x0D]"
#: Faults of a row, the first that holds.
OK, BLANK, DUPLICATE, CUT_OFF, DROPPED = range(5)
# States of the role order: nothing yet, after the system's row, after a user's, after an assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Longer runs of inserts cost more than the same script without a pair of them.
LONGEST_RUN = 2
FAR = 1 << 60
#: Text of a task's rows, about.
PART_BYTES = 64 << 20

Layer = tuple[tuple[int, int] | None, ...]  # (cost over the layer's least, rank) of each state that can be reached
Step = tuple[Layer, int, tuple]  # the next layer, what its least cost adds, (parent, macro) of each state


def _inserted(state: int) -> Iterator[tuple[int, int]]:
    """(number of inserts, state after them)."""
    for n in range(LONGEST_RUN + 1):
        yield n, state
        state = NEXT[state].get("u", NEXT[state].get("a"))


@lru_cache(None)
def macros(initial: str, fault: int) -> tuple[tuple[int, str, int, int], ...]:
    """(state before, macro, state after, cost) of the edits that a row allows."""
    out = []
    for state in NEXT:
        for n, at in _inserted(state):
            out.append((state, "I" * n + "D", at, INSERT * n + DELETE))
            if fault in (BLANK, DUPLICATE):
                continue
            more = INSERT * n + (TRUNCATED if fault == CUT_OFF else 0)
            for role, after in NEXT[at].items():
                if role == initial:
                    out.append((state, "I" * n + "K", after, more + KEEP))
                if role != "s":
                    out.append((state, "I" * n + "R", after, more + REROLE))
    return tuple(out)


def _ranked(best: dict[int, tuple[int, tuple]]) -> tuple[Layer, int]:
    """The layer of the states' (cost, script so far as something that compares), and its least cost."""
    least = min(c for c, _ in best.values())
    order = {key: k for k, key in enumerate(sorted(key for _, key in best.values()))}
    return tuple((best[s][0] - least, order[best[s][1]]) if s in best else None for s in NEXT), least


@lru_cache(None)
def step(layer: Layer, initial: str, fault: int) -> Step:
    best: dict[int, tuple[int, tuple]] = {}
    for state, macro, after, cost in macros(initial, fault):
        if layer[state] is not None:
            found = (layer[state][0] + cost, (layer[state][1], macro, state))
            if after not in best or found < best[after]:
                best[after] = found
    following, least = _ranked(best)
    return following, least, tuple((best[s][1][2], best[s][1][1]) if s in best else None for s in NEXT)


def begun(state: int) -> Layer:
    return tuple((0, 0) if s == state else None for s in NEXT)


def ending(layer: Layer) -> tuple[int, int, str]:
    """(cost, state, inserts at the end) of the best complete script."""
    ends = {EMPTY: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
    cost, _, state = min((layer[s][0] + INSERT * len(ends[s]), layer[s][1], s) for s in NEXT if layer[s] is not None)
    return cost, state, ends[state]


def forward(codes: list[tuple[str, int]], state: int) -> tuple[Layer, int, list[tuple]]:
    """The last layer, the cost of its least, and the parent pointers of each layer."""
    layer, total, parents = begun(state), 0, []
    for initial, fault in codes:
        layer, more, parent = step(layer, initial, fault)
        total += more
        parents.append(parent)
    return layer, total, parents


def backward(parents: list[tuple], state: int) -> list[str]:
    """The macros that lead to the state."""
    out = []
    for parent in reversed(parents):
        state, macro = parent[state]
        out.append(macro)
    return out[::-1]


def repaired(rows: list[tuple[str, str]], edits: list[str], state: int, end: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows that the script leaves, from the state before them."""
    for (role, text), macro in zip([*rows, ("", "")], [*edits, end + "D"], strict=True):
        for edit in macro:
            if edit == "D":
                continue
            if edit == "K":
                state = NEXT[state][role[:1]]
                yield role, text
            else:
                state = NEXT[state].get("u", NEXT[state].get("a"))
                yield ROLE[state], text if edit == "R" else ""


# Rows with faults, in order


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: a fifth of the places where rows break, by a hash of conversation and turn, each in another way. Dropped rows stay, with a null text, so that no conversation is lost."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(way == 0, F.lit(None)).when(way == 1, "").when(way == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(way == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    rows = conversations.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(way == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def _fault(text: Column, again: Column) -> Column:
    """The first fault that holds; null: a dropped row."""
    last = F.regexp_extract(text, r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(text.isNull(), DROPPED).when(~text.rlike(BLANK_TEXT), BLANK).when(again, DUPLICATE).when(~last.isin(".", "!", "?"), CUT_OFF).otherwise(OK)


def in_order(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest, fault, part (the task): sorted over all tasks, and written. A duplicate is known by conversation, role and a SHA-256 digest of the text."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("here", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    rows = rows.withColumn("at", F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn")))
    key = ["here", "alone", "role", "digest"]
    rows = rows.withColumn("alone", F.col("conv_id").isNull())
    several = rows.filter(F.col("text").isNotNull()).groupBy(*key).agg(F.count("*").alias("n"), F.min("at").alias("first")).filter("n > 1")
    rows = group_join(rows, cut(several), key, ["turn"])
    # Equal rows of one turn stand side by side: all but the first of them are told there.
    again = F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    rows = rows.select("conv_id", "turn", "role", "text", "digest", _fault(F.col("text"), again).alias("fault"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    parts = max(shuffle_partitions(rows.sparkSession), size // PART_BYTES + 1)
    return cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))


# A task's rows, conversation by conversation


class Part:
    """The rows of one conversation in one task."""

    def __init__(self, rows: list[tuple]):
        self.rows, self.turns = [], []
        self.faults, self.codes = [], []
        before = None
        for _, turn, role, text, digest, fault, _ in rows:
            if fault == DROPPED:
                continue
            if fault in (OK, CUT_OFF) and before == (turn, role, digest):
                fault = DUPLICATE
            before = (turn, role, digest)
            self.rows.append((role, text))
            self.turns.append(turn)
            self.faults.append(fault)
            self.codes.append((role[:1] if role[:1] in ("s", "u", "a") else "", fault))

    def counts(self) -> dict:
        known = [t for t in self.turns if t is not None]
        initials = [role[:1] for role, _ in self.rows]
        count = lambda f: sum(x == f for x in self.faults)
        return {
            "n": len(self.rows), "low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known)), "blank": count(BLANK), "duplicate": count(DUPLICATE), "truncated": count(CUT_OFF),
            "illegal": sum(misplaced(a, b) for a, b in zip(initials, initials[1:], strict=False)), "head": initials[0] if initials else None, "tail": initials[-1] if initials else None,
        }


def misplaced(a: str, b: str) -> int:
    """1 if the initials may not follow each other."""
    return int(a + b not in ("su", "ua", "au"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], bool, bool]]:
    """(rows, whether it is the task's first, whether it is its last and not its first) of each conversation."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    first, waiting = True, None
    for _, own in groupby(rows, key=lambda r: (r[0] is None, r[0])):
        if waiting is not None:
            yield waiting, first, False
            first = False
        waiting = list(own)
    if waiting is not None:
        yield waiting, first, not first


_COUNTS = "n long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string"
_OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _row(counts: dict, cost: int, audit: str, sha: str) -> tuple:
    gaps = counts["high"] - counts["low"] + 1 - counts["turns"] if counts["low"] is not None else 0
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit, sha


def _borders(kind: pa.DataType) -> Callable:
    """For mapInArrow: what the first and the last conversation of a task are, and from which state to which they lead at what cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for rows, first, last in _parts(batches):
            if not first and not last:
                continue
            own = Part(rows)
            costs, ranks = [], []
            for state in NEXT:
                layer, total, _ = forward(own.codes, state)
                costs += [total + x[0] if x else FAR for x in layer]
                ranks += [x[1] if x else 0 for x in layer]
            found.append((rows[0][0], rows[0][-1], last, *own.counts().values(), costs, ranks))
        if found:
            c = [list(x) for x in zip(*found, strict=True)]
            names = ["conv_id", "part", "last", *[x.split()[0] for x in _COUNTS.split(", ")], "costs", "ranks"]
            types = [kind, pa.int32(), pa.bool_(), *[pa.int64()] * 8, pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], names=names)

    return run


def joined(parts: list[dict]) -> tuple[dict, int, list[tuple[int, int]], str]:
    """Counts, cost, (state before, state after) of each part and the inserts at the end, of a conversation in several tasks; parts in order."""
    layer, total, parents = begun(EMPTY), 0, []
    counts = {"low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    tail = None
    for p in parts:
        best: dict[int, tuple[int, tuple]] = {}
        for state in NEXT:
            for after in NEXT:
                if layer[state] is not None and p["costs"][4 * state + after] < FAR:
                    found = (layer[state][0] + p["costs"][4 * state + after], (layer[state][1], p["ranks"][4 * state + after], state))
                    if after not in best or found < best[after]:
                        best[after] = found
        layer, more = _ranked(best)
        total += more
        parents.append({s: best[s][1][2] for s in best})
        if p["n"]:
            counts["illegal"] += p["illegal"] + (misplaced(tail, p["head"]) if tail is not None else 0)
            tail = p["tail"]
        for c in ("blank", "duplicate", "truncated"):
            counts[c] += p[c]
        if p["low"] is not None:
            # A turn may go on in the next task.
            counts["turns"] += p["turns"] - int(counts["high"] == p["low"])
            counts["low"] = p["low"] if counts["low"] is None else counts["low"]
            counts["high"] = p["high"]
    cost, state, end = ending(layer)
    way = []
    for parent in reversed(parents):
        way.append((parent[state], state))
        state = parent[state]
    return counts, total + cost, way[::-1], end


#: Of each conversation that stands in several tasks, by (part, last): its number, the states before and after, the inserts at the end.
Elsewhere = dict[tuple[int, bool], tuple[int, int, int, str]]


def _script(own: Part, place: tuple[int, int, int, str] | None) -> tuple[list[str], int, str, int]:
    """(edits, state before, inserts at the end, cost if all rows are here)."""
    if place:
        return backward(forward(own.codes, place[1])[2], place[2]), place[1], place[3], 0
    layer, total, parents = forward(own.codes, EMPTY)
    cost, state, end = ending(layer)
    return backward(parents, state), EMPTY, end, total + cost


def _whole(kind: pa.DataType, elsewhere: Elsewhere) -> Callable:
    """For mapInArrow: a row for each conversation that stands in one task only."""
    names = ["conv_id", *[c.split()[0] for c in _OUT.split(", ")]]
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for rows, first, last in _parts(batches):
            if (first or last) and (rows[0][-1], last) in elsewhere:
                continue
            own = Part(rows)
            edits, state, end, cost = _script(own, None)
            sha = hashlib.sha256("\n".join(map(":".join, repaired(own.rows, edits, state, end))).encode()).hexdigest()
            held.append((rows[0][0], *_row(own.counts(), cost, "".join(edits) + end, sha)))
            if len(held) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return run


def _scripts(elsewhere: Elsewhere) -> Callable:
    """For mapInArrow: (conv, part, at, edits, repaired) of the conversations in several tasks, a row for some edits. conv: its number; edits: the audit's part; repaired: the repaired rows, each with a line end."""
    names, some = ["conv", "part", "at", "edits", "repaired"], 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first, last in _parts(batches):
            place = elsewhere.get((rows[0][-1], last)) if first or last else None
            if not place:
                continue
            own = Part(rows)
            edits, state, end, _ = _script(own, place)
            made = repaired(own.rows, edits, state, end)
            for at in range(0, max(1, len(edits)), some):
                audit = "".join(edits[at : at + some]) + (end if at + some >= len(edits) else "")
                text = "".join(f"{role}:{x}\n" for role, x in islice(made, sum(e != "D" for e in audit))).encode()
                yield pa.RecordBatch.from_arrays([pa.array([place[0]]), pa.array([rows[0][-1]], pa.int32()), pa.array([at]), pa.array([audit]), pa.array([text], pa.binary())], names=names)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, audit, repaired_sha256) from pieces in order; one conversation's pieces pass one after the other."""
    now, sha, audit, line = None, None, [], b""

    def out() -> pa.RecordBatch:
        sha.update(line[:-1])
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], names=["conv", "audit", "repaired_sha256"])

    for b in batches:
        for conv, edits, made in zip(*(b.column(c).to_pylist() for c in ("conv", "edits", "repaired")), strict=True):
            if conv != now:
                if now is not None:
                    yield out()
                now, sha, audit, line = conv, hashlib.sha256(), [], b""
            audit.append(edits)
            if made:
                sha.update(line)
                line = made
    if now is not None:
        yield out()


def _places(rows: DataFrame, arrow: pa.DataType) -> tuple[Elsewhere, list[tuple]]:
    """Where the conversations in several tasks stand, and for each: conv_id and the counts and cost of its row. rows: ``in_order``."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    slim = rows.select("conv_id", "turn", "role", F.lit("").alias("text"), "digest", "fault", "part")
    # Two rows a task at most.
    borders = slim.mapInArrow(_borders(arrow), f"conv_id {kind}, part int, last boolean, {_COUNTS}, costs array<long>, ranks array<long>").collect()
    elsewhere, several = {}, []
    for _, own in groupby(sorted(borders, key=lambda r: (r["part"], r["last"])), key=lambda r: (r["conv_id"] is None, r["conv_id"])):
        own = [r.asDict() for r in own]
        if len(own) > 1:
            counts, cost, way, end = joined(own)
            for r, (before, after) in zip(own, way, strict=True):
                elsewhere[r["part"], r["last"]] = (len(several), before, after, end if r is own[-1] else "")
            several.append((own[0]["conv_id"], *_row(counts, cost, "", "")[:-2]))
    return elsewhere, several


def _kind(rows: DataFrame) -> tuple[str, pa.DataType]:
    kind = rows.schema["conv_id"].dataType.simpleString()
    return kind, {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of conversations (conv_id, turn, role, text); a null text marks a row that is not there."""
    spark, rows = rows.sparkSession, in_order(rows)
    kind, arrow = _kind(rows)
    elsewhere, several = _places(rows, arrow)
    out = rows.mapInArrow(_whole(arrow, elsewhere), f"conv_id {kind}, {_OUT}")
    if not several:
        return out
    pieces = rows.mapInArrow(_scripts(elsewhere), "conv long, part int, at long, edits string, repaired binary")
    pieces = pieces.repartition(min(len(several), shuffle_partitions(spark)), "conv").sortWithinPartitions("conv", "part", "at")
    ends = pieces.mapInArrow(_digests, "conv long, audit string, repaired_sha256 string")
    facts = spark.createDataFrame([(k, *r) for k, r in enumerate(several)], f"conv long, conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")
    return out.unionByName(ends.join(F.broadcast(facts), "conv").select(*out.columns))  # at most a row a task


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, part, at, role, text: the repaired conversations themselves, in the order of part and at."""
    rows = in_order(rows)
    kind, arrow = _kind(rows)
    elsewhere, _ = _places(rows, arrow)
    names, types = ["conv_id", "part", "at", "role", "text"], [arrow, pa.int32(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own_rows, first, last in _parts(batches):
            own = Part(own_rows)
            edits, state, end, _ = _script(own, elsewhere.get((own_rows[0][-1], last)) if first or last else None)
            out = [(own_rows[0][0], own_rows[0][-1], at, *x) for at, x in enumerate(repaired(own.rows, edits, state, end))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return rows.mapInArrow(run, f"conv_id {kind}, part int, at long, role string, text string")
