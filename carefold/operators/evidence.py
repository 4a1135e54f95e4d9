"""Evidence for answers: citations, certainty, history in words, and answers made from the ledger alone.

Defined results: a cited id that is no fact is dropped; a repeated citation stays; an answer without citations is never
settled; blank texts count as missing; extra columns of answers are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carefold import vocabulary as V
from carefold.functions import clinical as C

# Fixed value: what an answer without evidence is followed by.
HEDGE = "I couldn't find a clear record supporting this in this patient's chart — please verify directly before relying on it."


def cite_label(label: Column | None = None) -> Column:
    """What a citation is called: the given label, the document's title, the document, the source, the fact's label."""
    names = [F.col("document_title"), F.col("source_document").cast("string"), F.col("source"), C.label(F.col("subject"), F.col("predicate"), F.col("value"))]
    return C.filled(*([] if label is None else [label]), *names)


def citations(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """(answer_id, place, id, source_document, document_title, page, valid_from, source) for ``answers`` (answer_id, cited)."""
    each = answers.select("answer_id", F.posexplode("cited").alias("place", "id"))
    return each.join(facts.select("id", "source_document", "document_title", "page", "valid_from", "source"), "id").select(
        "answer_id", "place", "id", "source_document", "document_title", "page", "valid_from", "source"
    )


def enforce_certainty(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """``answers`` (answer_id, cited, certainty) with certainty lowered: contested if a cited fact is, and not settled if
    an active one is less sure than LOW_CONFIDENCE; and ``grounded``, the number of cited facts that exist."""
    each = answers.select("answer_id", F.explode(F.array_distinct("cited")).alias("id")).join(facts.select("id", "status", "confidence"), "id")
    low = (F.col("status") == "active") & (F.col("confidence") < V.LOW_CONFIDENCE)
    of = each.groupBy("answer_id").agg(F.bool_or(F.col("status") == "contested").alias("disputed"), F.bool_or(low).alias("unsure"), F.count("*").alias("grounded"))
    lowered = F.when(F.col("disputed"), "contested").when((F.col("certainty") == "settled") & F.col("unsure"), "low_confidence").otherwise(F.col("certainty"))
    return answers.join(of, "answer_id", "left").select(
        *[c for c in answers.columns if c != "certainty"], lowered.alias("certainty"), F.coalesce("grounded", F.lit(0)).alias("grounded")
    )


def validate(answers: DataFrame) -> DataFrame:
    """``answers`` (text, certainty, grounded) that pass the gate: a settled text without citations becomes unsure and is
    hedged; ``checks`` says what was looked at."""
    bare = (F.col("grounded") == 0) & (F.col("certainty") == "settled") & (F.trim("text") != "")
    certainty = F.when(bare, "low_confidence").otherwise(F.col("certainty"))
    text = F.when(bare, F.concat(F.regexp_replace("text", r"\.+$", ""), F.lit(f". {HEDGE}"))).otherwise(F.col("text"))
    found = F.col("grounded") > 0
    checks = F.create_map(F.lit("grounded"), found, F.lit("cited"), found, F.lit("confidence_stated"), F.lit(True), F.lit("conflicting"), certainty == "contested")
    return answers.withColumns({"text": text, "certainty": certainty, "checks": checks})


def history_lines(facts: DataFrame) -> DataFrame:
    """(patient_id, id, line): each fact as a line of its chart's history."""
    day = lambda c: F.col(c).cast("string")
    line = F.concat(
        F.lit("- id="), day("id"), F.lit(" "), day("valid_from"), F.coalesce(F.concat(F.lit(" → "), day("valid_to")), F.lit("")),
        F.when(F.col("status") == "active", " [CURRENT] ").otherwise(F.concat(F.lit(" ["), F.col("status"), F.lit("] "))),
        F.col("subject"), F.lit("/"), F.col("predicate"), F.lit(": "), F.col("value"), F.lit(" (source: "), F.col("source"), F.lit(")"),
        F.when(F.col("confidence") < 1, F.concat(F.lit(" conf="), F.format_string("%.2f", F.col("confidence").cast("double")))).otherwise(""),
        F.coalesce(F.concat(F.lit(" reason: "), F.nullif("reason", F.lit(""))), F.lit("")),
    )
    return facts.select("patient_id", "id", line.alias("line"))


def short(facts: DataFrame) -> Column:
    """A fact in one line of a log."""
    span = F.concat(F.col("valid_from").cast("string"), F.coalesce(F.concat(F.lit("→"), F.col("valid_to").cast("string")), F.lit("")))
    return F.concat(F.lit("["), F.left(F.col("id").cast("string"), F.lit(8)), F.lit("] "), F.col("subject"), F.lit("/"), F.col("predicate"), F.lit(": "), F.col("value"), F.lit(" ("), span, F.lit(", "), F.col("status"), F.lit(", src="), F.col("source"), F.lit(")"))


def sentence() -> Column:
    """A fact as a sentence, for facts without a text of their own."""
    return F.concat(F.lit("On "), F.col("valid_from").cast("string"), F.lit(", patient "), F.col("patient_id").cast("string"), F.lit(" "), F.col("predicate"), F.lit(" "), F.col("subject"), F.lit(": "), F.col("value"), F.lit(" (source "), F.col("source"), F.lit(")."))


def fallback_answers(patients: DataFrame, facts: DataFrame) -> DataFrame:
    """(patient_id, text, certainty, grounded) from the active facts in order, or that there are none."""
    own = facts.groupBy("patient_id").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("status") != "retracted", 1)).alias("visible"), F.count(F.when(F.col("status") == "active", 1)).alias("grounded"),
        F.sort_array(F.collect_list(F.when(F.col("status") == "active", F.struct("valid_from", "id", F.concat(
            C.label(F.col("subject"), F.col("predicate"), F.col("value")), F.lit(" (since "), F.col("valid_from").cast("string"), F.lit(", source: "), F.col("source"), F.lit(")"),
        ).alias("p"))))).alias("points"),
    )
    text = (
        F.when(F.col("n").isNull(), "No records have been ingested for this patient yet.")
        .when(F.col("visible") == 0, "No active clinical records found for this patient.")
        .when(F.col("grounded") > 0, F.array_join(F.transform("points", lambda x: x["p"]), "; "))
        .otherwise("Could not synthesize answer")
    )
    return patients.select("patient_id").join(own, "patient_id", "left").select("patient_id", text.alias("text"), F.lit("low_confidence").alias("certainty"), F.coalesce("grounded", F.lit(0)).alias("grounded"))


def grounding_candidates() -> Column:
    """What a fact's entity may be called: its typed attribute, its value, and the words of both, each once."""
    kind = F.col("resource_type")
    typed = (
        F.when(kind.isin("Medication", "Allergy"), C.filled(F.col("drug"), F.col("substance")))
        .when(kind == "LabResult", F.col("analyte"))
        .when(kind.isin("Condition", "FamilyHistory"), F.col("condition"))
    )
    whole = F.filter(F.array(F.trim(F.coalesce(typed, F.lit(""))), F.trim(F.coalesce("value", F.lit("")))), lambda x: x != "")
    words = F.flatten(F.transform(whole, lambda x: F.split(F.replace(x, F.lit("/"), F.lit(" ")), r"\s+")))
    return F.array_distinct(F.concat(whole, F.filter(words, lambda w: w != "")))


def grounded(learned: dict[str, str] | None = None) -> Column:
    """Is one of the candidates in the vocabulary? Null without candidates."""
    names = grounding_candidates()
    return F.when(F.size(names) > 0, F.exists(names, lambda n: C.is_known(n, learned)))


def brief_rows(facts: DataFrame) -> DataFrame:
    """(patient_id, section, place, id, label, value, valid_from, status): the rows of a brief's sections, each in the order
    of days and ids from 1. Facts of no section, and retracted ones, have no row."""
    section = F.try_element_at(F.create_map(*[F.lit(x) for item in V.SECTIONS.items() for x in item]), F.col("resource_type"))
    rows = facts.filter("status <> 'retracted'").withColumn("section", section).filter("section IS NOT NULL")
    order = Window.partitionBy("patient_id", "section").orderBy("valid_from", "id")
    label = C.label(F.col("subject"), F.col("predicate"), F.col("value"))
    return rows.select("patient_id", "section", F.row_number().over(order).alias("place"), "id", label.alias("label"), "value", "valid_from", "status")
