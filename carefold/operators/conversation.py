"""Conversations: threads, what a turn adds up to, the audit trail.

Defined results: messages are ordered by turn; a thread without messages has no title; texts that are no JSON count as
empty; repeated turns are rows of their own; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carefold import vocabulary as V

#: Messages that an agent reads again: the first ones of a thread. Every so many of them a thread is indexed.
REPLAYED, INDEX_EVERY = 20, 5
META = "citations array<struct<fact_id:string>>, certainty string, trace array<struct<tool:string>>, cards array<struct<summary:string>>, pending struct<pending_id:string>"


def rank(certainty: Column) -> Column:
    out = F.lit(0)
    for name, n in V.CERTAINTY.items():
        out = F.when(certainty == name, n).otherwise(out)
    return out


def turn_rollup(trace: DataFrame) -> DataFrame:
    """(turn_id, actions, fact_id, certainty, pending, citations, cards) of the tool calls of each turn.

    ``trace`` has turn_id, seq, chip, fact_id, certainty, pending, citations and cards (arrays). The worst certainty,
    the last fact and the first proposal count; lists follow each other in the calls' order.
    """
    listed = lambda c: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.coalesce(c, F.array()).alias("x")))), lambda s: s["x"]))
    chips = F.transform(F.sort_array(F.collect_list(F.when(F.coalesce("chip", F.lit("")) != "", F.struct("seq", "chip")))), lambda s: s["chip"])
    given = lambda c: F.when(F.col(c).isNotNull(), F.col("seq"))
    return trace.groupBy("turn_id").agg(
        chips.alias("actions"), F.max_by("fact_id", given("fact_id")).alias("fact_id"), F.coalesce(F.max_by("certainty", F.when(rank(F.col("certainty")) > 0, rank(F.col("certainty")))), F.lit("settled")).alias("certainty"),
        F.min_by("pending", given("pending")).alias("pending"), listed("citations").alias("citations"), listed("cards").alias("cards"),
    )


def replay(messages: DataFrame, most: int = REPLAYED) -> DataFrame:
    """The first ``most`` messages of each thread."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return messages.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).drop("nth")


def index_points(messages: DataFrame) -> DataFrame:
    """(conv_id, turn): the user's turns at which a thread is indexed: the messages before it, REPLAYED at most, are a
    multiple of INDEX_EVERY. So a long thread is indexed at every turn."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    prior = F.least(F.row_number().over(order) - 1, F.lit(REPLAYED))
    return messages.withColumn("prior", prior).filter(f"role = 'user' AND prior % {INDEX_EVERY} = 0").select("conv_id", "turn")


def with_meta(messages: DataFrame) -> DataFrame:
    """``messages`` with the fields of their meta, a JSON text: certainty is settled and lists are empty where it has none."""
    meta = F.from_json("meta", META)
    empty = lambda c: F.coalesce(meta[c], F.array()).alias(c)
    return messages.select("*", empty("citations"), F.coalesce(meta["certainty"], F.lit("settled")).alias("certainty"), empty("trace"), empty("cards"), meta["pending"].alias("pending"))


def audit_rows(calls: DataFrame) -> DataFrame:
    """(doctor, patient_id, action, decision, evidence_ids): a row of the audit trail for each call: a missing doctor is
    unknown, decisions end at 500 characters, evidence is a JSON list."""
    return calls.select(
        F.coalesce(F.nullif("doctor", F.lit("")), F.lit("unknown")).alias("doctor"), "patient_id", "action", F.left(F.coalesce("decision", F.lit("")), F.lit(500)).alias("decision"),
        F.to_json(F.coalesce("evidence", F.array().cast("array<bigint>"))).alias("evidence_ids"),
    )


def write_once(writes: DataFrame, seen: DataFrame) -> DataFrame:
    """``writes`` (key, seq, result) with the result that counts and deduped: a known key gives what was recorded, a
    repeated one its first result."""
    first = writes.groupBy("key").agg(F.min_by(F.struct("seq", "result"), "seq").alias("first"))
    met = writes.join(first, "key").join(seen.select("key", F.col("result").alias("old")), "key", "left")
    again = F.col("old").isNotNull() | (F.col("seq") > F.col("first.seq"))
    return met.select("key", "seq", F.coalesce("old", "first.result").alias("result"), again.alias("deduped"))
