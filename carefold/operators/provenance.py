"""Why a fact is as it is: trends of readings, what replaced what, and charts as graphs.

``facts`` are (id, patient_id, subject, label, valid_from, valid_to, superseded_by, status, source, reason, reading):
``reading`` is a number or null. Defined results: facts of one day are ordered by id; retracted facts are in no graph;
a fact without another reading says so; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carefold import vocabulary as V
from carefold.functions import clinical as C
from carefold.operators import ledger


def trends(facts: DataFrame) -> DataFrame:
    """(patient_id, subject, n, first, last, seq, since, until, trend, wrong_way) of the active readings of a subject.

    The trend is 'single reading' below two of them; wrong_way is null unless it rises or falls.
    """
    at = F.struct("valid_from", "id")
    readings = facts.filter("status = 'active' AND reading IS NOT NULL")
    points = F.sort_array(F.collect_list(F.struct("valid_from", "id", "reading")))
    grouped = readings.groupBy("patient_id", "subject").agg(
        F.count("*").alias("n"), F.min_by("reading", at).alias("first"), F.max_by("reading", at).alias("last"),
        F.array_join(F.transform(points, lambda p: C.number_text(p["reading"])), " → ").alias("seq"), F.min("valid_from").alias("since"), F.max("valid_from").alias("until"),
    )
    trend = F.when(F.col("n") < 2, "single reading").when(F.col("last") == F.col("first"), "steady").when(F.col("last") > F.col("first"), "rising").otherwise("falling")
    analyte = F.regexp_replace(F.lower("subject"), "^lab ", "")
    wrong = F.when(trend.isin("rising", "falling"), (trend == "rising") == analyte.isin(V.RISING_BAD))
    return grouped.select("*", trend.alias("trend"), wrong.alias("wrong_way"))


def trend_reason(of: DataFrame) -> DataFrame:
    """``trends`` with reason, a sentence about each."""
    name, span = F.upper(F.regexp_replace("subject", "^lab ", "")), F.concat(F.lit("("), F.col("since").cast("string"), F.lit(" → "), F.col("until").cast("string"), F.lit(")"))
    verdict = F.when(F.col("wrong_way"), "trending the wrong way despite prior results").otherwise("trending in the right direction")
    steady = F.concat(name, F.lit(" has stayed steady at "), C.number_text(F.col("last")), F.lit(" across "), F.col("n").cast("string"), F.lit(" readings "), span, F.lit("."))
    moving = F.concat(name, F.lit(" is "), F.col("trend"), F.lit(": "), F.col("seq"), F.lit(" "), span, F.lit(" — "), verdict, F.lit("."))
    alone = F.concat(name, F.lit(" has no other dated readings on record to compare against."))
    return of.withColumn("reason", F.when(F.col("n") < 2, alone).when(F.col("trend") == "steady", steady).otherwise(moving))


def why(facts: DataFrame) -> DataFrame:
    """(id, replaced_by, reason, source, date, siblings): what replaced each fact, or how many active ones it has beside it.

    Source and date are the successor's where there is one, and so is the reason of a fact without its own.
    """
    after = facts.select(F.col("id").alias("superseded_by"), F.col("source").alias("s_source"), F.col("valid_from").alias("s_from"), F.col("reason").alias("s_reason"), F.lit(True).alias("there"))
    active = facts.filter("status = 'active'").groupBy("patient_id", "subject").agg(F.count("*").alias("k"))
    met = facts.join(after, "superseded_by", "left").join(active, ["patient_id", "subject"], "left")
    replaced = F.col("there").isNotNull()
    return met.select(
        "id", F.when(replaced, F.col("superseded_by")).alias("replaced_by"), F.coalesce(C.filled(F.col("reason"), F.when(replaced, F.col("s_reason"))), F.lit("")).alias("reason"),
        F.coalesce("s_source", "source").alias("source"), F.coalesce("s_from", "valid_from").alias("date"), F.when(~replaced & (F.col("k") > 1), F.col("k")).otherwise(0).cast("long").alias("siblings"),
    )


def answers(facts: DataFrame) -> DataFrame:
    """``why`` with the fact's place in its chain (chain, position, length) and the trend of its siblings.

    trend and trend_reason are those of the active readings of its subject, for facts that nothing replaced and that
    have siblings; chains of a cycle are null.
    """
    siblings = trend_reason(trends(facts)).select("patient_id", "subject", "trend", F.col("reason").alias("trend_reason"))
    place = facts.select("id", "patient_id", "subject")
    met = why(facts).join(place, "id").join(ledger.ranked(facts), "id").join(siblings, ["patient_id", "subject"], "left")
    shown = F.col("siblings") > 1
    return met.select(
        "id", "replaced_by", "reason", "source", "date", "siblings", "chain", "position", "length",
        F.when(shown, F.col("trend")).alias("trend"), F.when(shown, F.col("trend_reason")).alias("trend_reason"),
    )


def narratives(facts: DataFrame) -> DataFrame:
    """(patient_id, subject, narrative, fact_id): the history of each subject in words, and the fact to show.

    Replacements are listed if there are any; else the active readings if there are several; else the current fact.
    """
    after = facts.select(F.col("id").alias("superseded_by"), F.col("label").alias("to_label"), F.col("valid_from").alias("to_from"), F.col("source").alias("to_source"), F.col("reason").alias("to_reason"))
    day = lambda c: F.col(c).cast("string")
    line = F.concat(
        F.lit("• "), F.col("label"), F.lit(" ("), day("valid_from"), F.lit(", "), F.col("source"), F.lit(") was replaced by "), F.col("to_label"), F.lit(" ("), day("to_from"), F.lit(", "), F.col("to_source"), F.lit(")"),
        F.coalesce(F.concat(F.lit(" — reason: "), F.nullif("to_reason", F.lit(""))), F.lit("")),
    )
    at, active = F.struct("valid_from", "id"), F.col("status") == "active"
    now = F.struct("label", "valid_from", "source", "id")
    rows = facts.join(after, "superseded_by", "left").withColumn("line", line)
    rows = rows.groupBy("patient_id", "subject").agg(
        F.min_by("id", F.when(F.col("superseded_by").isNotNull(), at)).alias("first_replaced"),
        F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("valid_from", "id", "line")))).alias("lines"),
        F.sort_array(F.collect_list(F.when(active, F.struct("valid_from", "id", F.concat("label", F.lit(" ("), day("valid_from"), F.lit(")")).alias("p"))))).alias("points"),
        F.max_by(now, F.when(active, at)).alias("now"),
    )
    since = F.concat(F.col("now.label"), F.lit(" (since "), F.col("now.valid_from").cast("string"), F.lit(", source: "), F.col("now.source"), F.lit(")."))
    changes = F.concat(F.lit("Change history:\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.coalesce(F.concat(F.lit("\n\nCurrent state: "), since), F.lit("")))
    several = F.concat(
        F.lit("No single record replaced another — "), F.col("subject"), F.lit(" has "), F.size("points").cast("string"), F.lit(" readings on file, each still active: "),
        F.array_join(F.transform("points", lambda x: x["p"]), "; "), F.lit("."),
    )
    told = (
        F.when(F.col("first_replaced").isNotNull(), changes)
        .when(F.size("points") > 1, several)
        .when(F.size("points") == 1, F.concat(F.lit("Current: "), since, F.lit(" No prior changes recorded.")))
        .otherwise("No relevant changes found in the records.")
    )
    return rows.select("patient_id", "subject", told.alias("narrative"), F.coalesce("first_replaced", "now.id").alias("fact_id"))


def status_at(day: Column) -> Column:
    """active if the fact holds on the day, else superseded, also if it comes later."""
    return F.when((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day)), "active").otherwise("superseded")


def graph_nodes(facts: DataFrame, links: DataFrame, registry: DataFrame, day: Column) -> DataFrame:
    """(patient_id, node, kind, category, label, status): facts, and relatives by consented links."""
    own = facts.filter("status <> 'retracted'").select(
        "patient_id", F.concat(F.lit("fact:"), F.col("id").cast("string")).alias("node"), F.lit("fact").alias("kind"), F.coalesce("resource_type", F.lit("Other")).alias("category"), "label", status_at(day).alias("status")
    )
    names = registry.select(F.col("patient_id").alias("relative_id"), "name")
    who = links.filter("consent").join(names, "relative_id", "left")
    label = F.concat(C.title(F.col("relation")), F.lit(" · "), F.coalesce("name", F.col("relative_id").cast("string")))
    kin = who.select("patient_id", F.concat(F.lit("rel:"), F.col("relative_id").cast("string")), F.lit("relative"), F.lit("Family"), label, F.lit("active"))
    return own.union(kin)


def graph_edges(facts: DataFrame, links: DataFrame, same_subject: bool = False) -> DataFrame:
    """(source, target, kind, label): supersession, neighbours of one subject that it does not link, and relatives, who
    hang on their patient's earliest fact."""
    own = facts.filter("status <> 'retracted'")
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    out = own.filter("superseded_by IS NOT NULL").select(name("fact:", "id").alias("source"), name("fact:", "superseded_by").alias("target"), F.lit("SUPERSEDED_BY").alias("kind"), F.lit(None).cast("string").alias("label"))
    if same_subject:
        order = Window.partitionBy("patient_id", "subject").orderBy("valid_from", "id")
        pairs = own.select("id", "superseded_by", F.lead("id").over(order).alias("next"), F.lead("superseded_by").over(order).alias("next_by")).filter("next IS NOT NULL")
        linked = F.col("superseded_by").eqNullSafe(F.col("next")) | F.col("next_by").eqNullSafe(F.col("id"))
        out = out.union(pairs.filter(~linked).select(name("fact:", "id"), name("fact:", "next"), F.lit("SAME_SUBJECT"), F.lit(None)))
    anchor = own.groupBy("patient_id").agg(F.min_by("id", F.struct("valid_from", "id")).alias("anchor"))
    return out.union(links.filter("consent").join(anchor, "patient_id").select(name("fact:", "anchor"), name("rel:", "relative_id"), F.lit("RELATED_TO"), F.col("relation")))
