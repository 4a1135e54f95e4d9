"""Memory entries of other stores as rows: texts, graph nodes and edges in JSON, timelines, and what is recalled.

Defined results: texts that are no JSON have no fields; blank fields count as missing; a node without a name is a
Timestamp; a query without hits gets NOTHING; repeated rows stay; extra columns are kept where a function adds to rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carefold.functions import clinical as C

NOTHING = "No memory matches."


def _fields(raw: Column, *names: str) -> Column:
    """The first of the fields of a JSON object that is not blank."""
    v = F.try_parse_json(raw)
    return C.filled(*[F.trim(F.try_variant_get(v, f"$.{n}", "string")) for n in names])


def entry_text(raw: Column) -> Column:
    """What a memory entry says."""
    return _fields(raw, "text", "answer", "content")


def nodes(rows: DataFrame) -> DataFrame:
    """(id, label, type) of nodes in JSON: ``rows`` have id and raw, their properties."""
    kind = F.coalesce(_fields(F.col("raw"), "type", "node_type"), F.lit(""))
    named = _fields(F.col("raw"), "name", "text", "title", "label", "type", "node_type", "__class__")
    return rows.select(F.col("id").cast("string").alias("id"), F.coalesce(named, F.lit("Timestamp")).alias("label"), kind.alias("type"))


def edges(rows: DataFrame) -> DataFrame:
    """(source, target, type) of edges in JSON (raw)."""
    first = lambda *names: F.coalesce(_fields(F.col("raw"), *names), F.lit(""))
    return rows.select(first("source", "source_node_id").alias("source"), first("target", "target_node_id").alias("target"), first("relationship_name", "type", "label").alias("type"))


def timeline_facts(entries: DataFrame) -> DataFrame:
    """Facts of a timeline's entries (id, patient_id, subject, predicate, value, date, source, text)."""
    return entries.select(
        "id", "patient_id", "subject", "predicate", "value", F.try_to_date("date", "yyyy-MM-dd").alias("valid_from"), F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce("text", F.lit("")).alias("raw_text"), C.resource_type(F.lit(None).cast("string"), F.col("subject")).alias("resource_type"),
    )


def recalled(queries: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, text): the texts of the ids ``found`` (query_id, id, similarity), the most similar first, a line each."""
    lines = found.join(texts.select("id", "text"), "id").select("query_id", F.struct((-F.col("similarity")).alias("far"), "id", "text").alias("x"))
    joined = lines.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["text"]), "\n").alias("text"))
    return queries.select("query_id").distinct().join(joined, "query_id", "left").select("query_id", F.coalesce("text", F.lit(NOTHING)).alias("text"))


def answers(said: DataFrame, facts: DataFrame) -> DataFrame:
    """(patient_id, naive, smart): what a memory that is never corrected says, and the ledger's active facts.

    ``said`` (patient_id, id, valid_from, label) are the statements that the baseline was given.
    """
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("valid_from", "id", "label"))), lambda x: x["label"]), "; ")
    naive = said.groupBy("patient_id").agg(listed.alias("naive"))
    smart = facts.filter("status = 'active'").groupBy("patient_id").agg(listed.alias("smart"))
    return naive.join(smart, "patient_id", "full").select("patient_id", F.coalesce("naive", F.lit("")).alias("naive"), F.coalesce("smart", F.lit("")).alias("smart"))
