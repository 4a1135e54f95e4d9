"""Clinical resources in JSON, read into assertion rows.

Input rows have ``value``, the text of one bundle or bare resource; ``read`` makes them from files. Everything is
parsed by Spark's variant functions, so unknown fields cost nothing and a text that is no JSON gives no rows.

Defined results: null and broken texts give no rows; repeated texts give repeated rows; a resource of another kind
than those in KINDS is skipped; a resource without a name has the default of its kind; a missing date is ``today``, which
is the current date unless given; an observation without a quantity is about the patient's life and no laboratory
result; extra columns of the input are kept beside the assertion's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carefold.functions.clinical import canonical_analyte, canonical_flag, coerce_date

# Resource kinds, each with its resource type, what it is called without a name, and the states that end it.
KINDS = {
    "Observation": ("LabResult", "", []),
    "AllergyIntolerance": ("Allergy", "unknown allergen", ["inactive", "resolved"]),
    "MedicationRequest": ("Medication", "unknown medication", ["stopped", "completed"]),
    "MedicationStatement": ("Medication", "unknown medication", ["stopped", "completed"]),
    "Condition": ("Condition", "unknown condition", ["inactive", "resolved", "remission"]),
    "FamilyMemberHistory": ("FamilyHistory", "condition", []),
}
# What an assertion says at first and once it has ended, by resource type.
SAYS = {"LabResult": "measured", "Allergy": "diagnosed", "Medication": "prescribed", "Condition": "diagnosed", "FamilyHistory": "reported", "Lifestyle": "reported"}
ENDS = {"Allergy": "cleared", "Medication": "stopped", "Condition": "resolved"}

#: Where each kind keeps its date, first found first taken.
_DATES = ("effectiveDateTime", "onsetDateTime", "recordedDate", "dateAsserted", "authoredOn", "issued", "date")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(source, value): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), "value")


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _each(v: Column, path: str) -> Column:
    """The entries of a list, none if it is missing."""
    return F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))


def _label(v: Column, field: str = "") -> Column:
    """A coded concept's text, else the first display of its codings."""
    at = f"$.{field}" if field else "$"
    return F.coalesce(F.nullif(_get(v, f"{at}.text"), F.lit("")), _first(F.transform(_each(v, f"{at}.coding"), lambda c: _get(c, "$.display"))))


def _state(v: Column, field: str) -> Column:
    """A coded concept's text, else the first code of its codings, in lower case."""
    return F.lower(F.trim(F.coalesce(F.nullif(_get(v, f"$.{field}.text"), F.lit("")), _first(F.transform(_each(v, f"$.{field}.coding"), lambda c: _get(c, "$.code"))))))


def _by(kind: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for item in values.items() for x in item]), kind)


def resources(texts: DataFrame, places: bool = False) -> DataFrame:
    """The input's columns and ``r``, one variant per resource, bundles taken apart; with ``places`` also their ``place``."""
    parsed = texts.withColumn("_v", F.try_parse_json("value"))  # a filter here would parse every text twice
    entries = F.coalesce(_get(F.col("_v"), "$.entry", "array<variant>"), F.array().cast("array<variant>"))
    own = F.transform(entries, lambda e: _get(e, "$.resource", "variant"))
    is_bundle = F.coalesce(_get(F.col("_v"), "$.resourceType") == "Bundle", F.lit(False))
    every = F.when(is_bundle, own).otherwise(F.array("_v"))
    kept = texts.columns
    taken = parsed.select(*kept, F.posexplode(every).alias("place", "r")).filter("r IS NOT NULL")
    return taken if places else taken.drop("place")


def assertions(texts: DataFrame, today: Column | None = None) -> DataFrame:
    """The input's columns but ``value``, and per assertion: resource_type, predicate, subject, reading, unit,
    reference_range, flag, relation, age_at_onset, relative_name, reaction, severity, status, author, valid_from,
    patient_ref. A family history gives one row per condition of the relative, none without conditions.
    """
    kept = [c for c in texts.columns if c != "value"]
    r, c, kind, type_ = F.col("r"), F.col("c"), F.col("_kind"), F.col("_type")
    per = F.when(kind == "FamilyMemberHistory", _each(r, "$.condition")).otherwise(F.array("r"))
    rows = resources(texts).withColumn("_kind", _get(r, "$.resourceType")).filter(kind.isin(*KINDS)).withColumn("c", F.explode(per))
    measured = _get(r, "$.valueQuantity", "variant").isNotNull()
    rows = rows.withColumn("_type", F.when((kind == "Observation") & ~measured, "Lifestyle").otherwise(_by(kind, {k: t for k, (t, _, _) in KINDS.items()})))
    in_state = F.when(kind.startswith("Medication"), F.lower(_get(r, "$.status"))).otherwise(_state(r, "clinicalStatus"))
    state, ended = F.col("_state"), F.lit(False)
    for k, (_, _, states) in KINDS.items():
        ended = F.when(kind == k, state.isin(states) if states else F.lit(False)).otherwise(ended)
    name = (
        F.when(kind.startswith("Medication"), F.coalesce(_label(r, "medicationCodeableConcept"), _label(r, "medicationReference"), _label(r, "code")))
        .when(kind == "AllergyIntolerance", F.coalesce(_label(r, "code"), _label(r, "substance")))
        .when(kind == "FamilyMemberHistory", _label(c, "code"))
        .otherwise(_label(r, "code"))
    )
    called = F.coalesce(F.lower(F.trim(name)), F.when(type_ == "Lifestyle", "observation").otherwise(_by(kind, {k: d for k, (_, d, _) in KINDS.items()})))
    reading = F.coalesce(_get(r, "$.valueQuantity.value", "double").cast("string"), _get(r, "$.valueString"), _label(r, "valueCodeableConcept"))
    reactions = _each(r, "$.reaction")
    manifest = F.transform(reactions, lambda x: F.array_join(F.filter(F.transform(_each(x, "$.manifestation"), lambda m: _label(m)), lambda m: F.coalesce(m, F.lit("")) != ""), ", "))
    who = F.coalesce(*[_get(r, f"$.{w}", "variant") for w in ("recorder", "asserter", "requester")])
    date = F.coalesce(*[F.nullif(_get(r, f"$.{d}"), F.lit("")) for d in _DATES])
    # What functions look at again and again is a column of its own, taken from the variant once.
    rows, name = rows.withColumns({"_state": in_state, "_name": called, "_date": date, "_who": who}), F.col("_name")
    who = F.col("_who")
    out = rows.select(
        *kept,
        type_.alias("resource_type"),
        F.when(F.coalesce(ended, F.lit(False)), _by(type_, ENDS)).otherwise(_by(type_, SAYS)).alias("predicate"),
        F.when(type_ == "LabResult", canonical_analyte(name)).otherwise(name).alias("subject"),
        reading.alias("reading"),
        _get(r, "$.valueQuantity.unit").alias("unit"),
        _first(F.transform(_each(r, "$.referenceRange"), lambda x: _get(x, "$.text"))).alias("reference_range"),
        F.nullif(canonical_flag(_first(F.transform(_each(r, "$.interpretation"), lambda x: _label(x)))), F.lit("")).alias("flag"),
        F.when(kind == "FamilyMemberHistory", F.coalesce(F.lower(F.trim(_label(r, "relationship"))), F.lit("relative"))).alias("relation"),
        _get(c, "$.onsetAge.value", "int").alias("age_at_onset"),
        F.when(kind == "FamilyMemberHistory", F.nullif(_get(r, "$.name"), F.lit(""))).alias("relative_name"),
        _first(manifest).alias("reaction"),
        F.coalesce(_first(F.transform(reactions, lambda x: _get(x, "$.severity"))), _get(r, "$.criticality")).alias("severity"),
        state.alias("status"),
        F.coalesce(*[F.nullif(_get(who, f"$.{p}"), F.lit("")) for p in ("display", "reference")], F.lit("unknown")).alias("author"),
        coerce_date(F.col("_date"), today=today).alias("valid_from"),
        F.regexp_extract(F.coalesce(_get(r, "$.subject.reference"), _get(r, "$.patient.reference"), F.lit("")), r"([^/]*)$", 1).alias("patient_ref"),
    )
    return out


def _person(r: Column) -> tuple[Column, Column]:
    """(name, record number) of a Patient."""
    given = F.coalesce(_get(r, "$.name[0].given", "array<string>"), F.array().cast("array<string>"))
    name = F.coalesce(F.nullif(_get(r, "$.name[0].text"), F.lit("")), F.trim(F.concat_ws(" ", F.array_join(given, " "), _get(r, "$.name[0].family"))))
    ids = _each(r, "$.identifier")
    system = lambda x: F.lower(F.coalesce(_get(x, "$.system"), F.lit("")))
    is_number = lambda x: F.exists(_each(x, "$.type.coding"), lambda c: F.coalesce(_get(c, "$.code") == "MR", F.lit(False))) | system(x).rlike("mrn|medical-record")
    return name, _get(F.get(F.filter(ids, is_number), F.lit(0)), "$.value")


def patients(texts: DataFrame) -> DataFrame:
    """(patient_ref, name, dob, mrn) of the Patient resources; the name is its text, else given names and the family name;
    the number is the first identifier of type MR or of a system for record numbers."""
    r = F.col("r")
    name, mrn = _person(r)
    return resources(texts).filter(_get(r, "$.resourceType") == "Patient").select(
        _get(r, "$.id").alias("patient_ref"), name.alias("name"), F.try_to_date(_get(r, "$.birthDate"), "yyyy-MM-dd").alias("dob"), mrn.alias("mrn")
    )


def identity(texts: DataFrame) -> DataFrame:
    """(source, name, dob, mrn, ref) of each text: its first Patient, else the first reference of a resource to one."""
    r = F.col("r")
    name, mrn = _person(r)
    reference = F.regexp_extract(F.coalesce(_get(r, "$.subject.reference"), _get(r, "$.patient.reference"), F.lit("")), r"([^/]*)$", 1)
    is_patient = _get(r, "$.resourceType") == "Patient"
    rows = resources(texts, places=True).select("source", "place", F.when(is_patient, F.struct(name.alias("name"), _get(r, "$.birthDate").alias("dob"), mrn.alias("mrn"), _get(r, "$.id").alias("ref"))).alias("who"), F.nullif(reference, F.lit("")).alias("about"))
    found = rows.groupBy("source").agg(F.min_by("who", F.when(F.col("who").isNotNull(), F.col("place"))).alias("who"), F.min_by("about", F.when(F.col("about").isNotNull(), F.col("place"))).alias("about"))
    return found.select("source", "who.name", "who.dob", "who.mrn", F.when(F.col("who").isNotNull(), F.col("who.ref")).otherwise(F.col("about")).alias("ref"))
