"""Verdicts on statements, where one (patient, subject) may hold any share of all rows.

Statements are dealt out by ranges of (patient_id, subject, valid_from, id), so a large key spans many tasks, each
with a stretch of it in order. What a stretch makes of the active fact before it is a function that a few values
describe (``Stretch``): as long as statements repeat the active value it stays, the first other one closes it, and
from there on nothing depends on it any more. One pass describes each task's stretch, the driver puts these together
(one row for each task), and the second pass judges every statement from the active fact that its stretch begins with.

A pass handles a batch at a time with vectorised comparisons; only keys in which a value changes on the day of the
active fact are gone through run by run.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from carefold.storage import checkpointed

NEW, CONSISTENT, CONTRADICTS, SUPERSEDES = "NEW", "CONSISTENT", "CONTRADICTS", "SUPERSEDES"
KINDS = np.array([NEW, CONSISTENT, CONTRADICTS, SUPERSEDES], dtype=object)
COLUMNS = ["patient_id", "subject", "valid_from", "id", "value"]


def judge(new_key: np.ndarray, new_value: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(place in KINDS, the row of the active fact that it is about or -1, the last active row or -1) for rows in order.

    ``new_key`` and ``new_value`` tell whether a row's key or value is another than that of the row before it.
    """
    start = new_key | new_value
    first = np.flatnonzero(start)  # of each run of equal values
    run = np.cumsum(start) - 1
    kind = np.where(new_key, 0, np.where(start, 3, 1)).astype(np.int8)
    about = np.where(start, first[np.maximum(run - 1, 0)], first[run])
    about[new_key] = -1
    key = np.cumsum(new_key) - 1
    disputed = np.flatnonzero(~new_key[first[1:]] & (day[first[1:]] == day[first[:-1]])) + 1
    active = int(first[-1])
    end = np.append(first[1:], len(day))
    for k in np.unique(key[first[disputed]]).tolist():
        active_of = -1
        for r in range(int(np.searchsorted(key[first], k)), int(np.searchsorted(key[first], k, "right"))):
            i, behind = int(first[r]), int(end[r])
            if active_of >= 0 and day[i] == day[active_of]:
                kind[i], about[i], active_of = 2, active_of, -1
                i += 1
                if i == behind:
                    continue
            kind[i], about[i] = (3, active_of) if active_of >= 0 else (0, -1)
            about[i + 1 : behind] = active_of = i
        if k == key[-1]:
            active = active_of
    return kind, about, active


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value is another than the one before it; the first is."""
    return np.concatenate([[True], pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)]).astype(bool)


def _days(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int32()).to_numpy(zero_copy_only=False)


class Scan:
    """Goes through a task's rows in order; ``active`` is the active fact as a batch of one row, or None."""

    def __init__(self, active: pa.RecordBatch | None = None, foreign: bool = False):
        self.active, self.restated, self.foreign = active, 0, foreign

    def feed(self, batch: pa.RecordBatch) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """(rows, kind, about, facts that are closed by now): the rows begin with the active one before, if there is any."""
        rows = pa.Table.from_batches([batch] if self.active is None else [self.active, batch]).combine_chunks()
        column = lambda c: rows.column(c).combine_chunks()
        new_key = _changes(column("patient_id")) | _changes(column("subject"))
        kind, about, last = judge(new_key, _changes(column("value")), _days(column("valid_from")))
        self.before = int(self.active is not None)
        self.n = np.bincount(about[kind == 1], minlength=len(kind))
        if self.before:
            self.n[0] += self.restated
        closed = np.flatnonzero(kind != 1)
        closed = closed[closed != last]
        if self.before and self.foreign:
            closed = closed[closed != 0]
        self.foreign = self.foreign and self.before and last == 0
        self.active = rows.slice(last, 1).to_batches()[0] if last >= 0 else None
        self.restated = int(self.n[last]) if last >= 0 else 0
        return rows, kind, about, closed


@dataclass
class Stretch:
    """What a task's rows make of the active fact before them; facts are (patient, subject, day, id, value)."""

    first: tuple
    #: Rows of the first value, and the first row of another value in the same key.
    repeats: int
    other: tuple | None
    #: Whether all rows are of one key, and the last active facts if the first row, the one behind it, ``other`` or the
    #: one behind that is the first that counts. Of several keys the last one begins in the stretch.
    one_key: bool
    ends: list = field(default_factory=list)

    def closing(self, active: tuple) -> tuple | None:
        return self.other if active[4] == self.first[4] else self.first

    def then(self, active: tuple | None) -> tuple | None:
        """The active fact behind the stretch."""
        if not self.one_key or active is None:
            return self.ends[0]
        if active[4] != self.first[4]:
            return self.ends[active[2] == self.first[2]]
        return active if self.other is None else self.ends[2 + (active[2] == self.other[2])]


def _tuple(batch: pa.RecordBatch | pa.Table | None, i: int = 0) -> tuple | None:
    return None if batch is None else tuple(batch.column(c)[i].as_py() for c in COLUMNS)


def describe(batches: Iterator[pa.RecordBatch]) -> Stretch | None:
    """The stretch that a task's rows are; None if there are none."""
    out, scans, place, runs_on = None, [Scan()], 0, True
    begin = [0, 1, None, None]  # the rows with which each of the scans begins
    for batch in batches:
        if not batch.num_rows:
            continue
        if out is None:
            out = Stretch(_tuple(batch), 0, None, True)
            scans += [Scan(), Scan(), Scan()]
        if out.one_key:
            own = pc.and_(pc.equal(batch.column("patient_id"), pa.scalar(out.first[0], batch.schema.field("patient_id").type)), pc.equal(batch.column("subject"), pa.scalar(out.first[1], batch.schema.field("subject").type)))
            size = batch.num_rows if pc.all(own).as_py() else int(pc.index(own, False).as_py())
            out.one_key = size == batch.num_rows
            if runs_on:
                other = pc.index(pc.equal(batch.column("value").slice(0, size), pa.scalar(out.first[4], batch.schema.field("value").type)), False).as_py()
                out.repeats += size if other < 0 else other
                if other >= 0:
                    runs_on, out.other = False, _tuple(batch, other)
                    begin[2:] = [place + other, place + other + 1]
            for scan, at in zip(scans[1:], begin[1:], strict=True):
                if out.one_key and at is not None and at < place + batch.num_rows:
                    scan.feed(batch.slice(max(0, at - place)))
        scans[0].feed(batch)
        place += batch.num_rows
    if out is not None:
        out.ends = [_tuple(s.active) for s in scans]
    return out


def put_together(stretches: dict[int, Stretch]) -> dict[int, tuple[tuple | None, tuple]]:
    """By task: the active fact before its rows, and what becomes of the fact that is active behind them and began in
    them: (restatements in later tasks, the row that closes it or None, whether that contradicts it)."""
    out: dict[int, list] = {}
    active, owner = None, None
    for task, of in sorted(stretches.items()):
        if active is not None and active[:2] != of.first[:2]:
            active = None
        out[task] = [active, (0, None, False)]
        if active is not None:
            restated, by, disputed = out[owner][1]
            by = of.closing(active)
            out[owner][1] = (restated + (of.repeats if active[4] == of.first[4] else 0), by, by is not None and by[2] == active[2])
        behind = of.then(active)
        owner = owner if behind is not None and behind is active else task
        active = behind
    return {task: tuple(x) for task, x in out.items()}


def _ordered(statements: DataFrame) -> tuple[DataFrame, dict[int, tuple[tuple | None, tuple]]]:
    """The statements that count, dealt out and in order, and what ``put_together`` says of each task."""
    known = statements.select(*COLUMNS).na.drop()
    order = ["patient_id", "subject", "valid_from", "id"]
    rows = checkpointed(known.repartitionByRange(*order).sortWithinPartitions(*order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = describe(batches)
        if found is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(found)], pa.binary())], ["task", "stretch"])

    told = {r.task: pickle.loads(r.stretch) for r in rows.mapInArrow(run, "task int, stretch binary").collect()}  # a row for each task
    return rows, put_together(told)


def _begun(batch: pa.RecordBatch, active: tuple | None) -> Scan:
    if active is None:
        return Scan()
    arrays = [pa.array([x], batch.schema.field(c).type) for c, x in zip(COLUMNS, active, strict=True)]
    return Scan(pa.record_batch(arrays, schema=batch.schema), foreign=True)


def classify(statements: DataFrame) -> DataFrame:
    """(patient_id, subject, valid_from, id, value, classification, target): ``target`` is the fact that it is about."""
    rows, known = _ordered(statements)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if scan is None:
                scan = _begun(batch, known[TaskContext.get().partitionId()][0])
            every, kind, about, _ = scan.feed(batch)
            kind, about = kind[scan.before :], about[scan.before :]
            target = every.column("id").combine_chunks().take(pa.array(about, mask=about < 0))
            yield pa.record_batch([*batch.columns, pa.array(KINDS[kind], pa.string()), target], [*COLUMNS, "classification", "target"])

    schema = StructType(rows.schema.fields[:]).add("classification", "string").add("target", rows.schema["id"].dataType)
    return rows.mapInArrow(run, schema)


def facts(statements: DataFrame) -> DataFrame:
    """(patient_id, subject, valid_from, id, value, valid_to, superseded_by, contested, restated): the facts that
    statements make, with the statement that superseded each and how many restated it."""
    rows, known = _ordered(statements)
    names = [*COLUMNS, "valid_to", "superseded_by", "contested", "restated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, fate = None, (0, None, False)
        for batch in batches:
            if not batch.num_rows:
                continue
            if scan is None:
                active, fate = known[TaskContext.get().partitionId()]
                scan = _begun(batch, active)
            every, kind, about, closed = scan.feed(batch)
            by = np.full(len(kind), -1)
            by[about[kind == 3]] = np.flatnonzero(kind == 3)
            disputed = kind == 2
            disputed[about[kind == 2]] = True
            after = pa.array(by[closed], mask=by[closed] < 0)
            ends = [every.column(c).combine_chunks().take(after) for c in ("valid_from", "id")]
            own = every.take(pa.array(closed))
            yield pa.record_batch([*(own.column(c).combine_chunks() for c in COLUMNS), *ends, pa.array(disputed[closed]), pa.array(scan.n[closed], pa.int64())], names)
        if scan is not None and scan.active is not None and not scan.foreign:
            more, by, contradicted = fate
            kinds = [scan.active.schema.field(c).type for c in ("valid_from", "id")]
            ends = [pa.array([None if by is None or contradicted else by[i]], kind) for i, kind in zip((2, 3), kinds, strict=True)]
            yield pa.record_batch([*scan.active.columns, *ends, pa.array([contradicted]), pa.array([scan.restated + more], pa.int64())], names)

    schema = StructType(rows.schema.fields[:]).add("valid_to", rows.schema["valid_from"].dataType).add("superseded_by", rows.schema["id"].dataType)
    return rows.mapInArrow(run, schema.add("contested", "boolean").add("restated", "long"))
