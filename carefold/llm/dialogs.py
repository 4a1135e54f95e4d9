r"""Conversation structure repair (operator 13): the cheapest edits that give roles in the order system?, (user, assistant)+.

Method: run-length DP. A row is a symbol, its role's initial and what is wrong with it; equal symbols in a row are a run.
The states are what the next row may be: anything at the start, a user after the system, an assistant after a user, a
user or the end after an assistant. A symbol's transition is a matrix of least costs over these (min-plus), insertions
before the row included; a run is advanced by the cached binary powers of its symbol's matrix. Costs to the end are
found from the last run back to the first, kept for every KEPT-th run and made again from there; then the choices are
unrolled from the first row on: of the edits that lose nothing the least letter, inside a run by halves, with the costs
at their middle from the powers again. The audit's letters say all about the repaired roles.

Faults need what came before: equal rows of a turn are counted first (combined before the shuffle), and the first of a
(role, text) in its conversation is found by a second aggregation over these counts; a text is one digest there. Two
ordered passes follow. The first one has no texts: it goes through a conversation's symbols and holds a few bytes a
run. The second has the texts and the audit, and goes through both side by side. An audit and a digest are one value a
conversation, so its rows pass one task in order; that task holds the audit, never the rows.

Defined results: null roles, texts, turns and conv_ids are one space where they are damaged and in the repaired rows;
turns stay null for their order and their gaps, and a null conv_id is a conversation. Rows of one turn are in the order of their role and
their text's MD5. Role initials are characters as they stand, so an upper-case initial or an empty role fits nowhere.
An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carefold.llm._common import materialize, table

#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# States by what came last: nothing, the system, a user, an assistant; where a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: From a state, by the initial of the row that comes next.
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}

FAR = 1 << 60
#: Every KEPT-th run's costs are kept.
KEPT = 256

#: Symbols are numbers: a row that must go, or the initial's place here, doubled, and 1 more if it is truncated.
INITIALS = "sua"
GONE = 8

SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows after damage, ``n`` of each; a dropped row stays with 0 of it."""
    c = lambda name: F.coalesce(conversations[f"`{name}`"].cast("string"), F.lit(" "))
    how = F.pmod(F.crc32(F.concat(c("conv_id"), F.lit(":"), c("turn"))), F.lit(20))
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(c("text"), "[.!?]", "")).otherwise(c("text"))
    return conversations.select(
        conversations["`conv_id`"].cast("long").alias("conv_id"), conversations["`turn`"].cast("long").alias("turn"), F.when(how == 4, "user").otherwise(c("role")).alias("role"),
        text.alias("text"), F.when(how == 0, 0).when(how == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def is_truncated(text: Column) -> Column:
    r"""The last character that is no white space is not one of [.!?]."""
    return ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def counted(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, td, blank, cut, n, first): equal rows of a turn, and whether their first is the first of its
    role and text (td, a digest); a conversation whose rows are all dropped has one row, with 0 of it. A stored table."""
    there = F.col("n") > 0
    narrow = rows.select(
        "conv_id", F.when(there, F.col("turn")).alias("turn"), F.when(there, F.col("role")).alias("role"), F.when(there, F.unhex(F.md5("text"))).alias("td"),
        is_blank(F.col("text")).alias("blank"), is_truncated(F.col("text")).alias("cut"), "n",
    )
    key = ["conv_id", "turn", "role", "td"]
    flags = [F.max("blank").alias("blank"), F.max("cut").alias("cut"), F.sum("n").alias("n")]
    groups = materialize(narrow.groupBy(*key).agg(*flags), "dialog-groups")
    firsts = groups.filter("td IS NOT NULL").groupBy("conv_id", "role", "td").agg(F.min(F.struct("turn")).alias("at"))
    firsts = firsts.select("conv_id", "at.turn", "role", "td", F.lit(None).cast("boolean").alias("blank"), F.lit(None).cast("boolean").alias("cut"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("first"))
    both = groups.withColumn("first", F.lit(False)).unionByName(firsts)
    return materialize(both.groupBy(*key).agg(*flags, F.max("first").alias("first")), "dialog-rows")


# The DP.


def symbol(role: str, is_cut: bool) -> int:
    at = INITIALS.find(role[0]) if role else -1
    return 2 * (at if at >= 0 else len(INITIALS)) + is_cut


@cache
def edits(sym: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, next state) of what may be done with a row, and of the insertion before it (it stays on), by letter."""
    out = [("D", DELETE, state)]
    inserted = [("I", INSERT, USER if state != USER else ASSISTANT)]
    if sym != GONE:
        worse = TRUNCATED * (sym & 1)
        initial = (INITIALS + "x")[sym >> 1]
        if (state, initial) in STEPS:
            out.append(("K", worse, STEPS[state, initial]))
        out.append(("R", REROLE + worse, inserted[0][2]))
    return tuple(sorted(out + inserted))


@cache
def closing(state: int) -> int:
    """The least cost of insertions that end a conversation from a state."""
    return 0 if state in ENDS else INSERT + closing(edits(GONE, state)[1][2])


def _plus(a: tuple, b: tuple) -> tuple:
    """The min-plus product of two matrices."""
    return tuple(tuple(min(x + b[k][j] for k, x in enumerate(row)) for j in range(4)) for row in a)


@cache
def power(sym: int, k: int) -> tuple[tuple[int, ...], ...]:
    """The transition of 2 ** k rows of a symbol: the least cost from each state to each, insertions before rows included."""
    if k:
        return _plus(power(sym, k - 1), power(sym, k - 1))
    once, insert = [[FAR] * 4 for _ in range(4)], [[FAR] * 4 for _ in range(4)]
    for i in range(4):
        insert[i][i] = 0
        for letter, cost, j in edits(sym, i):
            of = insert if letter == "I" else once
            of[i][j] = min(of[i][j], cost)
    before = tuple(map(tuple, insert))
    return _plus(_plus(_plus(before, before), before), tuple(map(tuple, once)))  # more than 3 insertions only go around


def back(sym: int, n: int, after: tuple) -> tuple:
    """Costs to the end before ``n`` rows of a symbol, from those behind them."""
    k = 0
    while n:
        if n & 1:
            m = power(sym, k)
            after = tuple(min(x + y for x, y in zip(row, after, strict=True)) for row in m)
        n, k = n >> 1, k + 1
    return after


class Dialog:
    """A conversation's runs, a few bytes each, and the edits that they need."""

    def __init__(self) -> None:
        self.syms, self.lengths = bytearray(), array("q")

    def add(self, sym: int, n: int) -> None:
        if self.syms and self.syms[-1] == sym:
            self.lengths[-1] += n
        elif n:
            self.syms.append(sym)
            self.lengths.append(n)

    def solve(self) -> tuple[int, str]:
        """(least cost, the least audit of that cost)."""
        runs = len(self.syms)
        kept, after = {}, tuple(closing(s) for s in range(4))
        for i in range(runs - 1, -1, -1):
            if (i + 1) % KEPT == 0 or i == runs - 1:
                kept[i] = after  # costs behind run i
            after = back(self.syms[i], self.lengths[i], after)
        cost, state, audit = after[START], START, bytearray()
        for begin in range(0, runs, KEPT):
            last = min(begin + KEPT, runs) - 1
            behind = [kept.pop(last)]
            for i in range(last, begin, -1):
                behind.append(back(self.syms[i], self.lengths[i], behind[-1]))
            for i in range(begin, last + 1):
                state = unroll(self.syms[i], self.lengths[i], state, behind.pop(), audit)
        while state not in ENDS:
            audit += b"I"
            state = edits(GONE, state)[1][2]
        return cost, audit.decode()


def unroll(sym: int, n: int, state: int, after: tuple, audit: bytearray) -> int:
    """Appends the letters for ``n`` rows of a symbol, and returns the state behind them; ``after`` are the costs there."""
    parts = [(n, after)]
    while parts:
        n, after = parts.pop()
        if n > 1:
            half = n // 2
            parts += [(half, after), (n - half, back(sym, half, after))]
            continue
        while True:
            left = min(cost + (back(sym, 1, after) if letter == "I" else after)[to] for letter, cost, to in edits(sym, state))
            letter, to = next((letter, to) for letter, cost, to in edits(sym, state) if cost + (back(sym, 1, after) if letter == "I" else after)[to] == left)
            audit += letter.encode()
            state = to
            if letter != "I":
                break
    return state


# The two passes.


def summaries(rows: DataFrame) -> DataFrame:
    """SUMMARY of each conversation of ``rows`` (``counted``)."""
    order = ["conv_id", "turn", "role", "td"]
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, out = None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "blank", "cut", "n", "first"))
            for conv_id, turn, role, blank, cut, n, first in zip(*columns, strict=True):
                if one is None or one.conv_id != conv_id:
                    if one is not None:
                        out.append(one.row())
                    one = _Summary(conv_id)
                if n:
                    one.add(turn, role, blank, cut, n, first)
            yield _rows(out, names, kinds)
            out = []
        if one is not None:
            yield _rows([one.row()], names, kinds)

    return rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "blank", "cut", "n", "first").mapInArrow(run, SUMMARY)


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


class _Summary:
    """What is told of a conversation while its rows go by in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.dialog = conv_id, Dialog()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.turn = self.initial = None

    def add(self, turn: int | None, role: str, blank: bool, cut: bool, n: int, first: bool) -> None:
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.turn = turn
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.illegal += n - 1  # equal initials
        self.initial = initial
        again = 0 if blank else n - bool(first)
        self.blank += n if blank else 0
        self.duplicate += again
        if blank:
            self.dialog.add(GONE, n)
        elif first:
            self.truncated += cut
            self.dialog.add(symbol(role, cut), 1)
        self.dialog.add(GONE, again)

    def row(self) -> tuple:
        gaps = self.turn - self.least + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.dialog.solve())


def _both(rows: DataFrame, texts: DataFrame, told: DataFrame) -> DataFrame:
    """One ordered stream of a conversation's summary (kind 0), and for each of its counted rows (1) those with its text (2)."""
    none = lambda kind: F.lit(None).cast(kind)
    summary = told.select("conv_id", F.lit(0).alias("head"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("td"), F.lit(0).alias("kind"), F.struct(*told.columns).alias("told"), none("string").alias("text"), none("long").alias("n"), none("boolean").alias("stays"))
    stays = F.col("first") & ~F.col("blank")
    counts = rows.filter("n > 0").select("conv_id", F.lit(1).alias("head"), "turn", "role", "td", F.lit(1).alias("kind"), none(summary.schema["told"].dataType).alias("told"), none("string").alias("text"), "n", stays.alias("stays"))
    there = texts.filter("n > 0").filter(~is_blank(F.col("text")))
    said = there.select("conv_id", F.lit(1).alias("head"), "turn", "role", F.unhex(F.md5("text")).alias("td"), F.lit(2).alias("kind"), none(summary.schema["told"].dataType).alias("told"), "text", none("long").alias("n"), none("boolean").alias("stays"))
    every = summary.unionByName(counts).unionByName(said)
    return every.repartition("conv_id").sortWithinPartitions("conv_id", "head", "turn", "role", "td", "kind").select("told", "kind", "turn", "role", "text", "n", "stays")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, str | None, int | None, str, str]]:
    """(summary, edit, turn, role, text) of each row of the repaired conversations; one without an edit ends each of them."""
    told, audit, at, state, waiting, more = None, "", 0, START, None, 0

    def row(n: int) -> Iterator[tuple[str, str | None]]:
        """(edit, new role, if any) for the insertions before a row and for ``n`` rows."""
        nonlocal at, state
        while n and at < len(audit):
            letter, at = audit[at], at + 1
            if letter in "IR":
                state = USER if state != USER else ASSISTANT
                yield letter, ROLES[state]
            else:
                yield letter, None
            n -= letter != "I"

    def flush(n: int) -> Iterator[tuple]:
        for letter, role in row(n):
            if letter == "I":
                yield told, letter, None, role, ""

    for batch in batches:
        for summary, kind, turn, role, text, n, stays in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:
                if told is not None:
                    yield from flush(len(audit) + 1)
                    yield told, None, None, "", ""
                told, audit, at, state, waiting, more = summary, summary["audit"], 0, START, None, 0
            elif kind == 1:
                if not stays:
                    yield from flush(n)
                    continue
                for letter, new in row(1):
                    if letter == "I":
                        yield told, letter, None, new, ""
                    elif letter != "D":
                        waiting = (letter, new)
                        state = state if letter == "R" else STEPS[state, role[0]]
                more = n - 1
                if waiting is None:
                    yield from flush(more)
            elif waiting is not None:  # the first of the rows with the text that the count before them is of
                letter, new = waiting
                waiting = None
                yield told, letter, turn, new or role, text
                yield from flush(more)
    if told is not None:
        yield from flush(len(audit) + 1)
        yield told, None, None, "", ""


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(SUMMARY, the repaired rows (conv_id, place, turn, role, text, edit)) of ``conversations`` (conv_id, turn, role,
    text, n), ``n`` of each row as ``damaged`` gives them."""
    rows = counted(conversations)
    told = materialize(summaries(rows), "dialog-summaries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["conv_id", "place", "turn", "role", "text", "edit"], [*[pa.int64()] * 3, *[pa.string()] * 3]
        out, place = [], 0
        for summary, edit, turn, role, text in _walk(batches):
            if edit is None:
                place = 0
                continue
            out.append((summary["conv_id"], place, turn, role, text, edit))
            place += 1
            if len(out) == 1000:
                yield _rows(out, names, kinds)
                out = []
        yield _rows(out, names, kinds)

    return told, _both(rows, conversations, told).mapInArrow(run, "conv_id long, place long, turn long, role string, text string, edit string")


def digest(conversations: DataFrame) -> DataFrame:
    """SUMMARY and repaired_sha256, of the repaired rows ``role:text`` joined by newlines."""
    rows = counted(conversations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*(c.split()[0] for c in SUMMARY.split(", ")), "repaired_sha256"]
        kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
        out, hashed, joint = [], hashlib.sha256(), ""
        for summary, edit, _, role, text in _walk(batches):
            if edit is not None:
                hashed.update(f"{joint}{role}:{text}".encode())
                joint = "\n"
                continue
            out.append((*summary.values(), hashed.hexdigest()))
            hashed, joint = hashlib.sha256(), ""
            if len(out) == 1000:
                yield _rows(out, names, kinds)
                out = []
        yield _rows(out, names, kinds)

    return _both(rows, conversations, summaries(rows)).mapInArrow(run, f"{SUMMARY}, repaired_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(damaged(table(spark, sf_dir, "conversations")))
