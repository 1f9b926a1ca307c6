"""Conversation structure repair: the cheapest edits that make roles read ``(s?(ua)+)?``, by secondary-sorted streams.

A conversation is its rows by turn (nulls first); ties go by role, then by the
128-bit hash of the text, then repeats. A row's first fault counts: blank (no
character but ``\\x20\\x09-\\x0D``), duplicate (role and text came earlier) or
truncated (the last such character is none of ``.!?``). Edits are Keep (0), Rerole
to user or assistant (2), Delete (3; blank and duplicate rows must go) and Insert
of an empty-text user or assistant turn (2); a truncated row that stays adds 1.
Of the cheapest sequences of edits the one whose initials are ASCII-least is taken.

Two streams over partitions by conversation, each sorted by Spark and read batch
by batch in ``mapInPandas`` with the state carried on:

1. Rows without their texts, from the last to the first. The state is the cost to
   the end from each of four role states; each row leaves a byte, the best edit in
   each state. Bytes are spilled as rows of at most ``CHUNK`` to a table in the
   shared folder, so a giant conversation costs a task one chunk, and a lost
   executor loses none that is written.
2. Chunks and rows together, from the first to the last, a chunk ahead of its rows:
   the state is the role state and the place in the chunk, and edits come out.

Repeats of a row (same turn, role and text) travel as one row with a count, and
whether a text came earlier is found by an aggregate and a join, not in the stream:
no task holds a conversation or a set of its texts.

Defined results: a null role or text counts as one space; a null conv_id is a
conversation of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platen.llm.shared import small_batches, stored

#: Rows whose edits one spilled chunk has.
CHUNK = 1 << 16
BLANKS = " \t\n\x0b\x0c\r"
#: Role states: nothing yet; after system; after user; after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The one state that an inserted or reroled turn leads to, from each.
TURN = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
EDITS = "DIKR"
AT_END = (0, 4, 2, 0)
LEGAL = {"su", "ua", "au"}


def faulted(conversations: DataFrame, copies: str) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, role, text) -> the different rows with their texts, hashes and counts; the same without texts, with their faults.

    ``key`` is the conv_id as text; ``earlier``: the role and text stand in a turn before.
    """
    rows = conversations.select(
        F.col("conv_id").cast("string").alias("key"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        F.expr(copies).cast("long").alias("copies"),
    ).where("copies > 0")
    h = [F.xxhash64(F.lit(k), "text").alias(f"h{k}") for k in (0, 1)]
    rows = rows.groupBy("key", "turn", "role", *h).agg(F.min("text").alias("text"), F.sum("copies").alias("copies"))
    rows = stored(rows, "turns")
    trimmed = F.rtrim("text", F.lit(BLANKS))
    narrow = rows.select("key", "turn", "role", "h0", "h1", "copies", (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(*".!?")).alias("truncated"))
    first = narrow.groupBy("key", "role", "h0", "h1").agg(F.min(_placed("turn")).alias("first"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("key", "role", "h0", "h1")]
    joined = narrow.alias("r").join(first.alias("f"), same[0] & same[1] & same[2] & same[3])
    return rows, joined.select("r.key", "r.turn", "r.role", "r.h0", "r.h1", "r.copies", "r.blank", "r.truncated", (_placed("r.turn") > F.col("first")).alias("earlier"))


def _placed(turn: str) -> Column:
    """Turns as an order in which null is the first."""
    return F.struct(F.col(turn).isNotNull().cast("int"), F.col(turn))


def _order(descending: bool = False) -> list[Column]:
    by = [F.col("turn").desc_nulls_last() if descending else F.col("turn").asc_nulls_first()]
    return by + [F.col(c).desc() if descending else F.col(c).asc() for c in ("role", "h0", "h1")]


class Costs:
    """The costs to the end from each role state, carried from the last row to the first.

    What a row does to them depends on few things, so steps are remembered.
    """

    steps: dict[tuple, tuple[int, tuple[int, ...], int]] = {}

    def __init__(self) -> None:
        self.least, self.above = 0, AT_END

    def row(self, initial: str, truncated: bool, must_go: bool) -> int:
        """The byte of a row: two bits of an edit for each state."""
        what = (initial if initial in ("s", "u", "a") else "", truncated, must_go, self.above)
        step = self.steps.get(what)
        if step is None:
            step = self.steps[what] = _step(*what)
        byte, self.above, more = step
        self.least += more
        return byte

    def total(self) -> int:
        return self.least + self.above[START]


def _step(initial: str, truncated: bool, must_go: bool, after: tuple[int, ...]) -> tuple[int, tuple[int, ...], int]:
    """(byte, costs above the least, by how much the least grows) of one row before ``after``."""
    found: list[dict[str, int]] = []
    for state in range(4):
        costs = {"D": 3 + after[state]}
        if not must_go:
            if (state, initial) in NEXT:
                costs["K"] = truncated + after[NEXT[state, initial]]
            costs["R"] = 2 + truncated + after[TURN[state]]
        found.append(costs)
    plain = [min(c.values()) for c in found]
    best = list(plain)
    for _ in range(2):  # a turn put in before the row, or two
        best = [min(best[s], 2 + best[TURN[s]]) for s in range(4)]
    byte = 0
    for state in range(4):
        found[state]["I"] = 2 + best[TURN[state]]
        edit = min(e for e, cost in found[state].items() if cost == best[state])
        byte |= EDITS.index(edit) << 2 * state
    least = min(best)
    return byte, tuple(b - least for b in best), least


#: Columns of the spilled chunks; a conversation's last one (its first rows) has the facts of all of it.
FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
SPILLED = "key string, turn long, has_turn boolean, role string, h0 long, h1 long, edits binary, " + ", ".join(f"{c} long" for c in FACTS)


def _backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows from a conversation's last to its first -> chunks of the best edits."""
    key = carried = None
    out: list[tuple] = []

    def chunk(whole: bool) -> None:
        facts = (carried.gaps(), *carried.faults, carried.illegal, carried.costs.total()) if whole else (0,) * len(FACTS)
        out.append((key, *carried.first, bytes(reversed(carried.edits)), *facts))
        carried.edits.clear()

    for batch in batches:
        for name, turn, has, role, h0, h1, copies, blank, truncated, earlier in batch.itertuples(index=False, name=None):
            if carried is None or name != key:
                if carried is not None:
                    chunk(True)
                key, carried = name, _Conversation()
            elif len(carried.edits) >= CHUNK:
                chunk(False)
            carried.row(turn, has, role, h0, h1, copies, blank, truncated, earlier)
        if out:
            yield _framed(out)
            out.clear()
    if carried is not None:
        chunk(True)
        yield _framed(out)


def _framed(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in SPILLED.split(", ")]
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    return frame.astype({c: "Int64" for c in ("turn", "h0", "h1", *FACTS)} | {"has_turn": bool})


class _Conversation:
    """What the backward stream carries of one conversation."""

    def __init__(self) -> None:
        self.costs, self.edits = Costs(), bytearray()
        self.faults, self.illegal = [0, 0, 0], 0
        self.behind: str | None = None
        self.turns, self.lowest, self.highest = 0, None, None
        self.first: tuple = ()

    def row(self, turn: int, has: bool, role: str, h0: int, h1: int, copies: int, blank: bool, truncated: bool, earlier: bool) -> None:
        initial = role[:1]
        if has and turn != self.lowest:
            self.turns += 1
            self.lowest = turn
            self.highest = turn if self.highest is None else self.highest
        if self.behind is not None and initial + self.behind not in LEGAL:
            self.illegal += 1
        self.illegal += copies - 1  # a role follows itself
        self.behind = initial
        if blank:
            self.faults[0] += copies
        else:
            self.faults[1] += copies - (not earlier)
            self.faults[2] += truncated and not earlier
        # Repeats must go, whatever the state: 'D' comes before every other edit and costs 3.
        self.costs.least += 3 * (copies - 1)
        self.edits.append(self.costs.row(initial, truncated, blank or earlier))
        self.first = (turn if has else None, has, role, h0, h1)

    def gaps(self) -> int:
        return self.highest - self.lowest + 1 - self.turns if self.turns else 0


REPAIRED = "key string, position long, turn long, role string, text string, edit string"
SUMMARY = "key string, " + ", ".join(f"{c} long" for c in FACTS) + ", audit string, repaired_sha256 string"


class _Repair:
    """What the forward stream carries of one conversation."""

    def __init__(self, facts: tuple) -> None:
        self.facts, self.state = facts, START
        self.edits, self.at = b"", 0

    def row(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str | None, str | None]]:
        """(edit, role, text) of the turns put in before a row and of the row; deleted ones have no role."""
        byte = self.edits[self.at]
        self.at += 1
        while (edit := EDITS[byte >> 2 * self.state & 3]) == "I":
            yield self.put("I", "")
        if edit == "K":
            self.state = NEXT[self.state, role[:1]]
            yield "K", role, text
        else:
            yield self.put("R", text) if edit == "R" else ("D", None, None)
        for _ in range(copies - 1):
            yield "D", None, None

    def put(self, edit: str, text: str) -> tuple[str, str, str]:
        self.state = TURN[self.state]
        return edit, ROLE[self.state], text

    def end(self) -> Iterator[tuple[str, str, str]]:
        while self.state not in (START, ASSISTANT):
            yield self.put("I", "")


def _forward(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, _Repair, int | None, list | None]]:
    """Chunks and rows from the first to the last -> (key, what is carried, turn, edits); edits None: the conversation has ended."""
    key = carried = None
    for batch in batches:
        for name, turn, has, role, text, copies, edits, *facts in batch.itertuples(index=False, name=None):
            if carried is None or name != key:
                if carried is not None:
                    yield key, carried, None, list(carried.end())
                    yield key, carried, None, None
                key, carried = name, _Repair(tuple(facts))
            if edits is not None:
                carried.edits, carried.at = edits, 0
            else:
                yield key, carried, turn if has else None, list(carried.row(role, text, copies))
        yield key, carried, None, []
    if carried is not None:
        yield key, carried, None, list(carried.end())
        yield key, carried, None, None


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    out: list[tuple] = []
    audit, digest, first = bytearray(), hashlib.sha256(), True
    for key, carried, _, edits in _forward(batches):
        if edits is None:
            out.append((key, *map(int, carried.facts), audit.decode(), digest.hexdigest()))
            audit, digest, first = bytearray(), hashlib.sha256(), True
            continue
        for edit, role, text in edits:
            audit += edit.encode()
            if role is not None:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if len(out) >= 1000:
            yield pd.DataFrame(out, columns=names)
            out = []
    yield pd.DataFrame(out, columns=names)


def _turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in REPAIRED.split(", ")]
    out: list[tuple] = []
    position = 0
    for key, _, turn, edits in _forward(batches):
        if edits is None:
            position = 0
            continue
        for edit, role, text in edits:
            if role is not None:
                out.append((key, position, None if edit == "I" else turn, role, text, edit))
                position += 1
        if len(out) >= 1000:
            yield pd.DataFrame(out, columns=names).astype({"turn": "Int64"})
            out = []
    yield pd.DataFrame(out, columns=names).astype({"turn": "Int64", "position": "Int64"})


def _streamed(conversations: DataFrame, copies: str) -> DataFrame:
    """The sorted rows and chunks that the forward stream reads."""
    small_batches(conversations.sparkSession)
    texts, facts = faulted(conversations, copies)
    has = F.col("turn").isNotNull().alias("has_turn")
    turn = F.coalesce("turn", F.lit(0)).alias("turn")  # no nulls, so pandas keeps whole numbers
    back = facts.repartition("key").sortWithinPartitions("key", *_order(descending=True))
    spilled = stored(back.select("key", turn, has, "role", "h0", "h1", "copies", "blank", "truncated", "earlier").mapInPandas(_backward, SPILLED), "edits")
    no_facts = [F.lit(0).cast("long").alias(c) for c in FACTS]
    rows = texts.select("key", "turn", "role", "h0", "h1", F.lit(1).alias("kind"), "text", "copies", F.lit(None).cast("binary").alias("edits"), *no_facts)
    chunks = spilled.select("key", "turn", "role", "h0", "h1", F.lit(0).alias("kind"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), "edits", *FACTS)
    both = rows.unionByName(chunks).repartition("key").sortWithinPartitions("key", *_order(), "kind")
    return both.select("key", turn, has, "role", "text", "copies", "edits", *FACTS)


def _with_ids(found: DataFrame, conversations: DataFrame) -> DataFrame:
    return found.withColumn("conv_id", F.col("key").cast(conversations.schema["conv_id"].dataType)).drop("key")


def repair_turns(conversations: DataFrame, copies: str = "1") -> DataFrame:
    """The repaired conversations: (conv_id, position, turn, role, text, edit), without what was deleted; turn is null where a turn was inserted."""
    return _with_ids(_streamed(conversations, copies).mapInPandas(_turns, REPAIRED), conversations).select("conv_id", "position", "turn", "role", "text", "edit")


def repair_structure(conversations: DataFrame, copies: str = "1") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conversation.

    A row stands for as many as the expression ``copies`` says; conversations of which no row is left have zeros, no edits and the hash of nothing.
    """
    found = _streamed(conversations, copies).mapInPandas(_summaries, SUMMARY)
    ids = conversations.select(F.col("conv_id").cast("string").alias("key")).distinct()
    joined = ids.alias("i").join(found.alias("s"), F.col("i.key").eqNullSafe(F.col("s.key")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return _with_ids(
        joined.select("i.key", *(F.coalesce(f"s.{c}", F.lit(0)).cast("long").alias(c) for c in FACTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")), conversations
    ).select("conv_id", *FACTS, "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """Faults by crc32 of ``conv_id:turn`` (nulls: one space) modulo 20: 0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it the user's."""
    space = F.lit(" ")
    h = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text = F.coalesce("text", space)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(h == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"),
    )
