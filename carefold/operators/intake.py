"""From files to facts: formats, extracted rows, documents, patients' identity, duplicates and batches.

Defined results: blank texts count as missing; a row that lacks what its type requires gives no assertion; a document
without assertions gives no facts; the same file twice is a duplicate of the first; null contents are empty; extra
columns are kept where a function says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carefold.functions import clinical as C

# Endings of image files, and resources that are read.
IMAGES = ["png", "jpg", "jpeg", "webp", "heic", "heif", "tif", "tiff", "bmp", "gif"]
RESOURCES = ["Bundle", "AllergyIntolerance", "MedicationStatement", "MedicationRequest", "Condition", "Observation", "FamilyMemberHistory"]

#: What facts take from their document.
OF_DOCUMENT = ("patient_id", "doc_date", "author", "title", "text")

ASSERTION = (
    "resource_type", "subject", "predicate", "value", "date", "source", "analyte", "reading", "unit", "ref_range", "abnormal_flag", "drug", "substance", "reaction",
    "severity", "condition", "relation", "age_at_onset", "relative_name", "relative_dob", "relative_mrn", "factor", "factor_value",
)


def is_bundle(content: Column) -> Column:
    """Is the text a bundle or a resource that is read?"""
    return F.coalesce(F.try_variant_get(F.try_parse_json(content), "$.resourceType", "string").isin(RESOURCES), F.lit(False))


def sniff_format(filename: Column, content: Column) -> Column:
    """pdf, image, csv, fhir or text, by the name's ending; .json is fhir only if its content is."""
    name = F.lower(filename)
    return (
        F.when(name.endswith(".pdf"), "pdf")
        .when(name.rlike(rf"\.({'|'.join(IMAGES)})$"), "image")
        .when(name.endswith(".csv"), "csv")
        .when(name.endswith(".json") & is_bundle(content), "fhir")
        .otherwise("text")
    )


def assertions(rows: DataFrame, default_date: Column, source: Column) -> DataFrame:
    """Extracted rows as typed assertions: the columns of ``rows`` that are not read, and ASSERTION.

    ``rows`` have resource_type, value, date, cleared, substance, reaction, severity, drug, condition, analyte,
    numeric_value, unit, ref_range, abnormal_flag, relation, age_at_onset, factor, relative_name, relative_dob and
    relative_mrn. Zero is no number and no age. A row of another type with a value becomes a note.
    """
    text = lambda c: F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))
    low, keep = lambda c: F.nullif(C.norm(text(c)), F.lit("")), lambda c: F.nullif(F.trim(text(c)), F.lit(""))
    kind, value, cleared = C.norm(F.col("resource_type")), text("value"), F.coalesce("cleared", F.lit(False))
    substance, drug, condition, analyte, factor = (C.filled(F.col(c), value) for c in ("substance", "drug", "condition", "analyte", "factor"))
    number, age = F.nullif(F.col("numeric_value"), F.lit(0.0)), F.nullif(F.col("age_at_onset"), F.lit(0))
    day = F.coalesce(keep("date"), F.trim(default_date))
    name = C.canonical_analyte(analyte)
    shown = F.coalesce(C.number_text(number), value)
    measured = F.trim(F.concat_ws(" ", F.trim(analyte), F.nullif(shown, F.lit("")), F.nullif(text("unit"), F.lit(""))))
    told = F.concat(C.title(F.trim(text("relation"))), F.lit(": "), F.trim(condition), F.coalesce(F.concat(F.lit(" (age "), age.cast("string"), F.lit(")")), F.lit("")))

    which = (
        F.when((kind == "allergy") & (substance != ""), "allergy")
        .when((kind == "medication") & (drug != ""), "medication")
        .when((kind == "condition") & (condition != ""), "condition")
        .when((kind == "labresult") & (analyte != ""), "lab")
        .when((kind == "familyhistory") & (text("relation") != "") & (condition != ""), "family")
        .when((kind == "lifestyle") & (factor != ""), "lifestyle")
        .when(kind.isin("vital", "procedure") & (value != ""), kind)
        .when(~kind.isin("allergy", "medication", "condition", "labresult", "familyhistory", "lifestyle") & (value != ""), "note")
    )
    same = F.col("resource_type")
    per_kind = {
        "resource_type": {"allergy": "Allergy", "medication": "Medication", "condition": "Condition", "lab": "LabResult", "family": "FamilyHistory", "lifestyle": "Lifestyle", "vital": same, "procedure": same},
        "subject": {"condition": "diagnosis", "lab": F.concat(F.lit("lab "), name), None: F.col("which")},
        "predicate": {
            "allergy": F.when(cleared, "cleared").otherwise("diagnosed"), "medication": "prescribed", "condition": F.when(cleared, "resolved").otherwise("diagnosed"), "lab": "measured",
            "vital": "measured", "procedure": "performed", "note": "recorded", None: "reported",
        },
        "value": {
            "allergy": F.trim(substance), "medication": F.trim(drug), "condition": F.trim(condition), "lab": measured, "family": told, "lifestyle": F.coalesce(keep(value), F.trim(factor)), None: value,
        },
        "date": {None: day}, "source": {None: source},
        "analyte": {"lab": name}, "reading": {"lab": F.coalesce(number, C.to_float(value))}, "unit": {"lab": F.nullif(text("unit"), F.lit(""))}, "ref_range": {"lab": F.nullif(text("ref_range"), F.lit(""))},
        "abnormal_flag": {"lab": F.nullif(C.canonical_flag(F.col("abnormal_flag")), F.lit(""))}, "drug": {"medication": low(drug)}, "substance": {"allergy": low(substance)},
        "reaction": {"allergy": keep("reaction")}, "severity": {"allergy": low("severity")}, "condition": {"condition": low(condition), "family": low(condition)}, "relation": {"family": low("relation")},
        "age_at_onset": {"family": age}, "relative_name": {"family": keep("relative_name")}, "relative_dob": {"family": keep("relative_dob")}, "relative_mrn": {"family": keep("relative_mrn")},
        "factor": {"lifestyle": low(factor)}, "factor_value": {"lifestyle": F.trim(value)},
    }
    types = {"reading": "double", "age_at_onset": "long"}

    def of_kind(column: str) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        out = lit(per_kind[column].get(None)).cast(types.get(column, "string"))
        for k, v in per_kind[column].items():
            out = F.when(F.col("which") == k, lit(v)).otherwise(out) if k else out
        return out.alias(column)

    read = {
        "resource_type", "value", "date", "cleared", "substance", "reaction", "severity", "drug", "condition", "analyte", "numeric_value", "unit", "ref_range",
        "abnormal_flag", "relation", "age_at_onset", "factor", "relative_name", "relative_dob", "relative_mrn",
    }
    kept = [c for c in rows.columns if c not in read]
    return rows.withColumn("which", which).filter("which IS NOT NULL").select(*kept, *map(of_kind, ASSERTION))


def facts_of(documents: DataFrame, asserted: DataFrame, today: Column | None = None) -> DataFrame:
    """Facts of documents: ``documents`` (doc_id, patient_id, doc_date, author, title, text), ``asserted`` (doc_id, subject,
    predicate, value, date, source, resource_type and attributes). Dates and sources fall back to the document's."""
    return facts_with(asserted.join(documents.select("doc_id", *OF_DOCUMENT), "doc_id"), today)


def facts_with(met: DataFrame, today: Column | None = None) -> DataFrame:
    """As ``facts_of``, of assertions that have their document's columns already (OF_DOCUMENT)."""
    own = {"subject": C.norm(F.col("subject")), "predicate": C.norm(F.col("predicate")), "value": F.trim("value")}
    kept = [c for c in met.columns if c not in {"doc_id", *OF_DOCUMENT, "date", "source", "resource_type", *own}]
    return met.select(
        "patient_id", *[v.alias(k) for k, v in own.items()], C.coerce_date(F.col("date"), F.col("doc_date"), today).alias("valid_from"),
        F.trim(F.coalesce(C.filled(F.col("source"), F.col("author")), F.lit("unknown"))).alias("source"), F.coalesce("text", F.lit("")).alias("raw_text"),
        F.col("doc_id").alias("source_document"), F.coalesce("title", F.lit("")).alias("document_title"), C.resource_type(F.col("resource_type"), own["subject"]).alias("resource_type"), *kept,
    )


def route(requests: DataFrame) -> DataFrame:
    """``requests`` (subject, predicate, value, date, text) with way: structured if all of a fact is there, else text to
    extract from, else error."""
    whole = F.lit(True)
    for c in ("subject", "predicate", "value", "date"):
        whole &= F.coalesce(F.col(c), F.lit("")) != ""
    return requests.withColumn("way", F.when(whole, "structured").when(F.coalesce("text", F.lit("")) != "", "text").otherwise("error"))


def merged_identity(pages: DataFrame) -> DataFrame:
    """(doc_id, name, dob, mrn, ref): of each field the first that is not blank, by page."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("page"))).alias(c)
    return pages.groupBy("doc_id").agg(*[first(c) for c in ("name", "dob", "mrn", "ref")])


def csv_identity(rows: DataFrame) -> DataFrame:
    """(doc_id, mrn, ref) of each file's first row; ``rows`` have doc_id, row, mrn and patient_id."""
    one = F.min_by(F.struct("mrn", "patient_id"), "row").alias("x")
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return rows.groupBy("doc_id").agg(one).select("doc_id", blank("x.mrn").alias("mrn"), blank("x.patient_id").alias("ref"))


def split_uploads(uploads: DataFrame, index: DataFrame, registry: DataFrame) -> DataFrame:
    """``uploads`` (upload_id, content, force) with duplicate_of, duplicate_patient and duplicate_name where the file is
    known by its hash, its patient still is one, and reprocessing is not forced.

    The ``index`` (hash, doc_id, patient_id) is as it stood before the batch: two equal files of a batch are both new.
    """
    hits = index.join(registry.select("patient_id", "name"), "patient_id").groupBy("hash").agg(F.min(F.struct("doc_id", "patient_id", "name")).alias("hit"))
    hashed = uploads.withColumn("hash", F.sha2(F.coalesce("content", F.lit("")), 256))
    known = F.when(~F.coalesce("force", F.lit(False)), F.col("hit"))
    return hashed.join(hits, "hash", "left").select(
        *uploads.columns, "hash", known["doc_id"].alias("duplicate_of"), known["patient_id"].alias("duplicate_patient"), known["name"].alias("duplicate_name")
    )


def record_uploads(index: DataFrame, done: DataFrame) -> DataFrame:
    """The hash index after a batch: (hash, doc_id, patient_id), the last of ``done`` (with seq) for each hash."""
    last = done.groupBy("hash").agg(F.max_by(F.struct("doc_id", "patient_id"), "seq").alias("x")).select("hash", "x.*")
    return index.join(last, "hash", "left_anti").select("hash", "doc_id", "patient_id").unionByName(last)


def ingest_plan(requests: DataFrame, documents: DataFrame, facts: DataFrame) -> DataFrame:
    """``requests`` (patient_id, doc_id) with way: missing, ALREADY (and the number of its facts) or ingest."""
    have = facts.filter("source_document IS NOT NULL").groupBy("patient_id", F.col("source_document").alias("doc_id")).agg(F.count("*").alias("n"))
    known = documents.select("patient_id", "doc_id", F.lit(True).alias("there"))
    met = requests.join(known, ["patient_id", "doc_id"], "left").join(have, ["patient_id", "doc_id"], "left")
    way = F.when(F.col("there").isNull(), "missing").when(F.col("n") > 0, "ALREADY").otherwise("ingest")
    return met.select(*requests.columns, way.alias("way"), F.when(F.col("there"), F.coalesce("n", F.lit(0))).cast("long").alias("facts"))


def outcomes(judged: DataFrame) -> DataFrame:
    """(doc_id, facts, classification, reason, healed, naive) of documents whose facts were judged: ``judged`` has doc_id,
    place, classification and reason. The last fact's class and the last reason count; a document with any correction
    is healed, and kept from the naive baseline as a whole."""
    healed = F.bool_or(F.col("classification").isin("SUPERSEDES", "CONTRADICTS"))
    told = F.max_by("reason", F.when(F.coalesce("reason", F.lit("")) != "", F.col("place")))
    return judged.groupBy("doc_id").agg(
        F.count("*").alias("facts"), F.max_by("classification", "place").alias("classification"), F.coalesce(told, F.lit("")).alias("reason"), healed.alias("healed"), (~healed).alias("naive")
    )


def pin_batch(files: DataFrame) -> DataFrame:
    """``files`` (batch, place, patient, error) with chart: the first file that resolves a patient decides for those
    after it; a failed file stops nothing and has its error."""
    before = Window.partitionBy("batch").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return files.withColumn("chart", F.first(F.when(F.col("error").isNull(), F.col("patient")), ignorenulls=True).over(before))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of JSON files, one or an array in each; files that can't be read give none."""
    rows = spark.read.schema(f"{schema}, _broken STRING").option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.filter("_broken IS NULL").drop("_broken")
