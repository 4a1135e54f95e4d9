"""Reconciliation of a stream of statements into a ledger of facts, one small state per (patient, subject).

The state of a key is its active fact only: id, value, first day and number of statements. Keys are dealt over SHARDS by
a hash, and a shard's active facts are kept together, so that a trigger costs a call for each shard and not for each key. ``ledger.verdict`` decides:
a statement with the active fact's value reinforces it; one with another value supersedes it, which emits the closed
fact; one with another value of the same day contradicts it, which emits both as contested and leaves none active.

Statements of a micro-batch are ordered by (valid_from, id) within their key. Across batches the order is that of
arrival, as statements are judged when they come: one that is older than the active fact is judged like any other, so
its fact may end before it began (valid_to < valid_from) and hold on no day. With ``strict`` such late statements are
not judged but emitted as they are, with status late, so that none is lost. A stream that comes in order gives the
batch's ledger.

A shard's rows of one trigger are sorted in one task, so the source's maxFilesPerTrigger bounds them; the replay of a
backlog is ``ledger.reconcile``'s work. Defined results: statements without a key, an id, a value or a date are dropped; a repeated id reinforces; an empty stream emits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from carefold.operators.ledger import CONSISTENT, CONTRADICTS, NEW, verdict

CLOSED = "patient_id long, subject string, id long, bucket long, valid_from date, valid_to date, superseded_by long, statements long, status string"
#: The active facts of a shard, a place for each; days are counted from 1970.
STATE = "patient_id array<long>, subject array<string>, id array<long>, bucket array<long>, day array<int>, statements array<long>"
#: Groups of keys; a stream's checkpoint holds for one number of them.
SHARDS = 1024
_OUT = "patient_id long, subject string, id long, bucket long, day int, until int, superseded_by long, statements long, status string"


def closed_facts(statements: DataFrame, strict: bool = False) -> DataFrame:
    """The facts that are active no more, as later statements supersede or contradict them.

    ``statements`` is a stream of (id, patient_id, subject, bucket, valid_from).
    """

    def step(shard: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {}
        if state.exists:
            patients, subjects, *facts = state.get
            held = dict(zip(zip(patients, subjects, strict=True), zip(*facts, strict=True), strict=True))
        out = []
        # A shard's rows of one trigger: pieces in turn, sorted as a whole.
        rows = pd.concat(list(batches)).sort_values(["patient_id", "subject", "day", "id"])
        for patient, subject, id_, bucket, day in zip(*(rows[c].tolist() for c in ("patient_id", "subject", "id", "bucket", "day")), strict=True):
            key = (patient, subject)
            active = held.get(key)
            if strict and active is not None and day < active[2]:
                out.append((*key, id_, bucket, day, None, None, 1, "late"))
                continue
            said = verdict(active, bucket, day)
            if said == CONSISTENT:
                held[key] = (*active[:3], active[3] + 1)
                continue
            if said == CONTRADICTS:
                out.append((*key, *active[:3], None, None, active[3], "contested"))
                out.append((*key, id_, bucket, day, None, None, 1, "contested"))
                del held[key]
                continue
            if said != NEW:
                out.append((*key, *active[:3], day, id_, active[3], "superseded"))
            held[key] = (id_, bucket, day, 1)
        if held:
            state.update((*map(list, zip(*held, strict=True)), *map(list, zip(*held.values(), strict=True))))
        elif state.exists:
            state.remove()
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])
        yield frame.astype({"until": "Int32", "superseded_by": "Int64"})

    known = statements.filter("patient_id IS NOT NULL AND subject IS NOT NULL AND id IS NOT NULL AND bucket IS NOT NULL AND valid_from IS NOT NULL")
    shard = F.pmod(F.xxhash64("patient_id", "subject"), F.lit(SHARDS)).cast("int").alias("shard")
    chosen = known.select(shard, "id", "patient_id", "subject", "bucket", F.unix_date("valid_from").alias("day"))
    closed = chosen.groupBy("shard").applyInPandasWithState(step, _OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    days = [F.date_from_unix_date(c).alias(name) for c, name in (("day", "valid_from"), ("until", "valid_to"))]
    return closed.select("patient_id", "subject", "id", "bucket", *days, "superseded_by", "statements", "status")


def once(statements: DataFrame, key: str = "id", at: str | None = None, within: str = "7 days") -> DataFrame:
    """A stream without repeated deliveries: the first row of each key stays.

    With ``at``, a column of timestamps, keys are kept for ``within`` after them and forgotten then, so the state is
    bounded by the deliveries of that time; without it every key is kept.
    """
    if at is None:
        return statements.dropDuplicates([key])
    return statements.withWatermark(at, within).dropDuplicatesWithinWatermark([key])
