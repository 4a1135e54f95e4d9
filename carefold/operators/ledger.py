"""The ledger of dated facts: reconciliation of statements, time travel, chains of supersession, retraction, merges.

A fact is (id, patient_id, subject, value, valid_from, valid_to, superseded_by, status, confidence); it holds from
valid_from until before valid_to.

Reconciliation reads a key's statements (patient, subject) in the order of (valid_from, id); ``verdicts`` says how a key
of any size is spread over tasks. Everything that follows from the verdicts is joins and aggregations. Defined results: statements without a patient,
subject, id, value or date are dropped; an empty table has no facts; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from carefold.operators import verdicts
from carefold.operators.verdicts import CONSISTENT, CONTRADICTS, NEW, SUPERSEDES
from carefold.storage import materialize

#: What a restatement adds to a fact's confidence, and the most that a contested fact has.
STEP, CONTESTED_MOST = 0.05, 0.5
#: Days before 1970 that dates are counted from, and the sizes of blocks of days, as powers of two.
_EPOCH, _SIZES = 719_528, 22
#: Pointers that are followed before the result is stored; a round goes JUMPS + 1 times as far as the one before.
JUMPS = 3


def verdict(active: tuple | None, value: object, day: object) -> str:
    """What a statement is to the active fact (id, value, valid_from) of its key; without one it is new.

    The same value restates it. Another value of the same day contradicts it: neither stays active. Any other
    supersedes it.
    """
    if active is None:
        return NEW
    if active[1] == value:
        return CONSISTENT
    return CONTRADICTS if active[2] == day else SUPERSEDES


def classify(statements: DataFrame) -> DataFrame:
    """(id, patient_id, subject, value, valid_from, classification, target): ``target`` is the fact that it is about."""
    return verdicts.classify(statements)


def reconcile(statements: DataFrame, confidence: float = 1.0) -> DataFrame:
    """The ledger that ``statements`` (id, patient_id, subject, value, valid_from) lead to.

    A superseded fact ends where the next begins; a contradiction leaves both facts contested, open, and out of what
    later statements are compared with; a restatement is no fact and makes its fact surer.
    """
    sure = F.least(F.lit(1.0), F.round(F.lit(confidence) + STEP * F.col("restated"), 4))
    return verdicts.facts(statements).select(
        "id", "patient_id", "subject", "value", "valid_from", "valid_to", "superseded_by",
        F.when(F.col("contested"), "contested").when(F.col("superseded_by").isNotNull(), "superseded").otherwise("active").alias("status"),
        F.when(F.col("contested"), F.least(sure, F.lit(CONTESTED_MOST))).otherwise(sure).alias("confidence"),
    )


def snapshot(facts: DataFrame, day: Column) -> DataFrame:
    """The facts that held on a day; retracted ones never did, superseded and contested ones may have."""
    held = (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.col("valid_to")))
    return facts.filter(held & (F.col("status") != "retracted"))


def held_on(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (patient_id, day and any columns) with the facts of the patient that held on the day, a row for each.

    An interval join: the days that a fact holds are cut into the fewest blocks of 1, 2, 4, ... days (two of a size at
    most), and a day is in one block of each size, so a fact and a day meet in exactly one block if it holds, and never
    else: an equi-join on patient and block, whose output is the answer. Rows are as in ``snapshot``; rows without a
    patient or a day, and facts that end before they begin, have no part; of equal names the columns of ``asked`` stay.
    """
    since, until = F.unix_date("valid_from") + _EPOCH, F.coalesce(F.unix_date("valid_to") + _EPOCH, F.lit(1 << _SIZES))
    rows = facts.filter("status <> 'retracted' AND valid_from IS NOT NULL").withColumns({"_a": since, "_b": until})
    first, last = "shiftright(_a + shiftleft(1, k) - 1, k)", "shiftright(_b, k)"
    sizes = f"sequence(0, {_SIZES})"
    odd_first = F.expr(f"transform({sizes}, k -> IF({first} < {last} AND {first} % 2 = 1, struct(k, {first} AS block), NULL))")
    odd_last = F.expr(f"transform({sizes}, k -> IF({first} < {last} AND {last} % 2 = 1, struct(k, {last} - 1 AS block), NULL))")
    blocks = rows.withColumn("_x", F.explode(F.array_compact(F.concat(odd_first, odd_last)))).withColumns({"_k": F.col("_x.k"), "_block": F.col("_x.block")})
    kept = [c for c in facts.columns if c not in asked.columns]
    blocks = blocks.select("patient_id", "_k", "_block", *kept)
    days = asked.filter("day IS NOT NULL").withColumn("_d", F.unix_date("day") + _EPOCH)
    days = days.withColumn("_x", F.explode(F.expr(f"transform({sizes}, k -> struct(k, shiftright(_d, k) AS block))")))
    days = days.withColumns({"_k": F.col("_x.k"), "_block": F.col("_x.block")}).drop("_x", "_d")
    return days.join(blocks, ["patient_id", "_k", "_block"]).select(*asked.columns, *kept)


def chains(facts: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, step, id): the facts from each of ``starts`` (id) on, by superseded_by, to the current truth.

    Paths are doubled, so the number of joins is the logarithm of the longest chain. A fact that is met again ends
    the chain; an unknown superseded_by ends it, too; an unknown start has none.
    """
    known = facts.select("id", "superseded_by")
    jumps = known.filter("superseded_by IS NOT NULL").join(known.select(F.col("id").alias("superseded_by")), "superseded_by", "left_semi")
    jumps = materialize(jumps.select("id", F.col("superseded_by").alias("to"), F.lit(1).cast("long").alias("far")), "chain-jumps")
    paths = materialize(starts.select("id").distinct().join(known.select("id"), "id").select(F.col("id").alias("start"), "id", F.lit(0).cast("long").alias("step")), "chain-paths")
    size = paths.count()
    while True:
        onward = paths.join(jumps, "id").select("start", F.col("to").alias("id"), (F.col("step") + F.col("far")).alias("step"))
        paths = materialize(paths.unionByName(onward).groupBy("start", "id").agg(F.min("step").alias("step")), "chain-paths")
        grown = paths.count()
        if grown == size:
            return paths.select("start", "step", "id")
        size = grown
        on = jumps.select(F.col("id").alias("to"), F.col("to").alias("beyond"), F.col("far").alias("more"))
        jumps = materialize(jumps.join(on, "to").select("id", F.col("beyond").alias("to"), (F.col("far") + F.col("more")).alias("far")), "chain-jumps")


def ranked(facts: DataFrame) -> DataFrame:
    """(id, chain, position, length): where each fact stands in its chain of supersession, a row for each id.

    List ranking by pointer jumping: each fact knows a later one and how far that is, and takes over what that one knows,
    JUMPS times a round, so the rounds are the logarithm of the longest chain and a round has a row a fact at most. ``chain`` is the last
    fact, ``position`` counts from 1 on; facts that share a successor are of one chain, whose length is that of its
    longest way. An unknown superseded_by ends a chain; facts of a cycle, or that lead into one, have nulls.
    """
    known = facts.groupBy("id").agg(F.max("superseded_by").alias("next"))
    there = known.select(F.col("id").alias("next"), F.lit(True).alias("there"))
    ends = F.col("there").isNull() | F.col("next").isNull()
    linked = known.join(there, "next", "left").select("id", F.when(ends, F.col("id")).otherwise(F.col("next")).alias("to"), F.when(ends, 0).otherwise(1).cast("long").alias("far"), ends.alias("done"))

    def stored(rows: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        return materialize(rows.observe(seen, F.count(F.when(~F.col("done"), 1)).alias("n")), "chain-ranks"), seen.get["n"]

    every, n = stored(linked)
    left = every.filter("NOT done")
    while n:
        on = every.select(F.col("id").alias("to"), F.col("to").alias("beyond"), F.col("far").alias("more"), F.col("done").alias("ends"))
        moved = left
        for _ in range(JUMPS):  # an end points to itself and is no way off
            moved = moved.join(on, "to").select("id", F.col("beyond").alias("to"), (F.col("far") + F.col("more")).alias("far"), F.col("ends").alias("done"))
        before = n
        moved, n = stored(moved)
        every, left = every.filter("done").unionByName(moved), moved.filter("NOT done")
        if n == before:  # the nearest one to an end would have found it
            break
    every = every.filter("done")
    lengths = every.groupBy("to").agg((F.max("far") + 1).alias("length"))
    out = every.join(lengths, "to").select("id", F.col("to").alias("chain"), (F.col("length") - F.col("far")).alias("position"), "length")
    if n:
        none = [F.lit(None).cast(out.schema[c].dataType).alias(c) for c in out.columns[1:]]
        out = out.unionByName(left.select("id", *none))
    return out


def retract(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """``facts`` after the facts of ``ids`` (id, reason) are retracted as entered in error.

    A retracted fact keeps its end and successor. The first fact that it superseded (the least valid_from, then id) is
    active again and open, whatever its status was; any other keeps pointing to it. Ids that are no facts change nothing.
    """
    gone = ids.groupBy("id").agg(F.min("reason").alias("why"))
    prior = facts.filter("superseded_by IS NOT NULL").join(gone.withColumnRenamed("id", "superseded_by"), "superseded_by")
    prior = prior.groupBy("superseded_by").agg(F.min_by(F.struct("id", "why"), F.struct("valid_from", "id")).alias("r")).select("r.id", F.col("r.why").alias("restored_for"))
    met = facts.join(gone, "id", "left").join(prior, "id", "left")
    back, out = F.col("restored_for").isNotNull(), F.col("why").isNotNull()
    changed = {
        "valid_to": F.when(~back, F.col("valid_to")),
        "superseded_by": F.when(~back, F.col("superseded_by")),
        "status": F.when(out, "retracted").when(back, "active").otherwise(F.col("status")),
    }
    if "reason" in facts.columns:
        told = F.concat(F.lit("restored: superseding fact retracted ("), F.col("restored_for"), F.lit(")"))
        changed["reason"] = F.when(out, F.col("why")).when(back, told).otherwise(F.col("reason"))
    return met.select(*[changed.get(c, F.col(c)).alias(c) for c in facts.columns])


def forget(facts: DataFrame, approved: DataFrame) -> DataFrame:
    """``retract`` for the approved ids whose facts exist and are not retracted yet."""
    due = facts.filter("status <> 'retracted'").select("id")
    return retract(facts, approved.join(due, "id", "left_semi"))


def upsert(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """``facts`` with the rows of ``changes`` in place of those with their id, or beside them; same columns, one row per id."""
    return facts.join(changes.select("id"), "id", "left_anti").select(*facts.columns).unionByName(changes.select(*facts.columns))


def delete(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is not in ``gone``; null keys stay."""
    return rows.join(gone.select(key).distinct(), key, "left_anti").select(*rows.columns)


def lookup(rows: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """``asked`` (with ``key``) and the columns of the row that has it, null where there is none."""
    return asked.join(rows, key, "left")


def conform(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` in a schema that grew: missing columns are null, others are cast, extra ones go."""
    fields = rows.sparkSession.createDataFrame([], schema).schema.fields
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
