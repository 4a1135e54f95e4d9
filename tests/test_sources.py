"""Resources in JSON, laboratory CSV, recall and the stream, on small inputs."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from carefold.functions.clinical import canonical_flag, coerce_date
from carefold.operators import recall
from carefold.sources import fhir, lab_csv
from carefold.streaming import reconcile


def test_bundle(spark, tmp_path):
    bundle = {
        "resourceType": "Bundle",
        "entry": [
            {"resource": {"resourceType": "Patient", "id": "p1", "birthDate": "1974-05-06", "name": [{"given": ["Ann", "B"], "family": "Cole"}], "identifier": [{"value": "x"}, {"system": "urn:MRN", "value": "MRN-1"}]}},
            {"resource": {"resourceType": "AllergyIntolerance", "code": {"text": "Penicillin"}, "clinicalStatus": {"coding": [{"code": "resolved"}]}, "recordedDate": "2021-08", "patient": {"reference": "Patient/p1"}, "reaction": [{"severity": "severe"}]}},
            {"resource": {"resourceType": "MedicationRequest", "medicationCodeableConcept": {"coding": [{"display": "Metformin"}]}, "status": "stopped", "authoredOn": "2019-03-18T10:00:00Z", "subject": {"reference": "p1"}}},
            {"resource": {"resourceType": "Practitioner", "id": "x"}},
        ],
    }
    member = {"resourceType": "FamilyMemberHistory", "name": "a string", "relationship": {"text": "Father"}, "date": "2023", "condition": [{"code": {"text": "Stroke"}, "onsetAge": {"value": 49}}, {"code": {"text": "Gout"}}]}
    for name, text in (("a", json.dumps(bundle)), ("b", json.dumps(member)), ("c", "no json {"), ("d", "")):
        (tmp_path / f"{name}.json").write_text(text)
    texts = fhir.read(spark, str(tmp_path))
    got = sorted(map(tuple, fhir.assertions(texts).select("source", "subject", "predicate", "relation", "age_at_onset", "severity", "valid_from", "patient_ref").collect()), key=repr)
    day = datetime.date
    assert got == [
        ("a.json", "metformin", "stopped", None, None, None, day(2019, 3, 18), "p1"),
        ("a.json", "penicillin", "cleared", None, None, "severe", day(2021, 8, 1), "p1"),
        ("b.json", "gout", "reported", "father", None, None, day(2023, 1, 1), ""),
        ("b.json", "stroke", "reported", "father", 49, None, day(2023, 1, 1), ""),
    ]
    assert [tuple(r) for r in fhir.patients(texts).collect()] == [("p1", "Ann B Cole", day(1974, 5, 6), "MRN-1")]
    assert fhir.assertions(spark.createDataFrame([(None,)], "value string")).collect() == []
    who = {r.source: tuple(r)[1:] for r in fhir.identity(texts).collect()}
    assert who == {"a.json": ("Ann B Cole", "1974-05-06", "MRN-1", "p1"), "b.json": (None, None, None, None)}


def test_resources_by_kind(spark):
    """States, defaults and where fields come from."""
    rows = [
        {"resourceType": "AllergyIntolerance", "criticality": "high", "recorder": {"reference": "Practitioner/7"}, "reaction": [{"severity": ""}, {"manifestation": [{"text": "hives"}, {"coding": [{"display": "rash"}]}]}]},
        {"resourceType": "AllergyIntolerance", "code": {"coding": [{"code": "1"}, {"display": "Latex"}]}, "clinicalStatus": {"coding": [{"code": "inactive"}]}},
        {"resourceType": "MedicationStatement", "status": "completed", "medicationCodeableConcept": {"text": "Zinc"}, "authoredOn": "2020-01-01", "dateAsserted": "2020-02-02", "requester": {"display": "Dr. X"}},
        {"resourceType": "Condition", "clinicalStatus": {"text": "Remission"}, "code": {"text": "Gout"}},
        {"resourceType": "Condition", "clinicalStatus": {"text": "active"}},
        {"resourceType": "Observation", "code": {"text": "LDL cholesterol"}, "valueQuantity": {"value": 0, "unit": "mg/dL"}, "interpretation": [{"coding": []}, {"text": "H"}], "referenceRange": [{}, {"text": "<100"}], "subject": {"reference": "Patient/p9"}},
        {"resourceType": "Observation", "code": {"text": "Pregnancy"}, "valueString": "yes"},
        {"resourceType": "FamilyMemberHistory", "name": "Ann", "condition": [{"code": {}}]},
        {"resourceType": "FamilyMemberHistory", "relationship": {"text": "Mother"}, "condition": []},
    ]
    texts = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i int, value string")
    got = {r.i: r for r in fhir.assertions(texts, F.to_date(F.lit("2024-05-06"))).collect()}
    say = lambda i: (got[i].resource_type, got[i].predicate, got[i].subject)
    assert [say(i) for i in sorted(got)] == [
        ("Allergy", "diagnosed", "unknown allergen"), ("Allergy", "cleared", "latex"), ("Medication", "stopped", "zinc"), ("Condition", "resolved", "gout"),
        ("Condition", "diagnosed", "unknown condition"), ("LabResult", "measured", "ldl"), ("Lifestyle", "reported", "pregnancy"), ("FamilyHistory", "reported", "condition"),
    ]
    assert (got[0].reaction, got[0].severity, got[0].author) == ("hives, rash", "high", "Practitioner/7")
    assert (got[2].author, str(got[2].valid_from), str(got[3].valid_from)) == ("Dr. X", "2020-02-02", "2024-05-06")
    assert (got[5].reading, got[5].flag, got[5].reference_range, got[5].patient_ref) == ("0.0", "high", "<100", "p9")
    assert (got[6].reading, got[7].relation, got[7].relative_name) == ("yes", "relative", "Ann")


def test_lab_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Patient_ID, Test ,value,unit,Ref_Range,Flag,date\np1,HbA1c,7.8,%,4-6,H,2024-06-12\np1,,1,,,,\np1,LDL,within limits,,,normal,bad\n")
    got = lab_csv.assertions(lab_csv.read(spark, str(tmp_path)), F.to_date(F.lit("2000-01-01"))).select("subject", "reading", "reference_range", "flag", "valid_from", "source").collect()
    assert [tuple(r) for r in got] == [("hba1c", "7.8", "4-6", "high", datetime.date(2024, 6, 12), None), ("ldl", "within limits", None, "normal", datetime.date(2000, 1, 1), None)]


@pytest.mark.parametrize("raw,want", [("2024-02-03T10:00", "2024-02-03"), ("2024-02", "2024-02-01"), ("2024", "2024-01-01"), ("2024-13-99", "2000-01-01"), ("x", "2000-01-01"), (None, "2000-01-01")])
def test_coerce_date(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string").select(coerce_date(F.col("raw"), today=F.to_date(F.lit("2000-01-01"))).alias("d"), canonical_flag(F.col("raw")).alias("f"))
    assert str(df.first().d) == want


def test_top_k(spark):
    rows = [(3, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [r.id for r in recall.top_k(vectors, [1.0, 0.1], 10).collect()] == [2, 3, 1]
    assert recall.top_k(vectors, [], 3).collect() == []


def test_stream_over_two_batches(spark, tmp_path):
    day = datetime.date
    schema = "id long, patient_id long, subject string, bucket long, valid_from date"
    one = [(1, 1, "a", 5, day(2024, 1, 1)), (2, 1, "a", 5, day(2024, 1, 2)), (3, 2, "a", 5, day(2024, 1, 2)), (9, None, "a", 1, day(2024, 1, 1))]
    two = [(4, 1, "a", 6, day(2024, 1, 3)), (5, 1, "a", 7, day(2023, 1, 1)), (6, 2, "a", 8, day(2024, 1, 2)), (7, 2, "a", 9, day(2024, 1, 2)), (8, 2, "a", 9, day(2024, 1, 4))]
    for i, rows in enumerate((one, two)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    contested = [(3, None, 1, "contested"), (6, None, 1, "contested")]
    for strict, want in (
        (True, [(1, 4, 2, "superseded"), *contested, (5, None, 1, "late")]),
        (False, [(1, 5, 2, "superseded"), *contested, (5, 4, 1, "superseded")]),
    ):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        to = f"{tmp_path}/out-{strict}"
        query = reconcile.closed_facts(reconcile.once(stream), strict).writeStream.format("parquet").option("checkpointLocation", f"{to}-state")
        query.trigger(availableNow=True).start(to).awaitTermination()
        got = sorted((r.id, r.superseded_by, r.statements, r.status) for r in spark.read.schema(reconcile.CLOSED).parquet(to).collect())
        assert got == sorted(want, key=lambda x: x[0])


def test_once_with_a_watermark(spark, tmp_path):
    rows = [(1, datetime.datetime(2024, 1, 1)), (1, datetime.datetime(2024, 1, 2)), (2, datetime.datetime(2024, 1, 2))]
    spark.createDataFrame(rows, "id long, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = reconcile.once(spark.readStream.schema("id long, at timestamp").parquet(f"{tmp_path}/in"), at="at")
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state")
    query.trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert sorted(r.id for r in spark.read.schema("id long, at timestamp").parquet(f"{tmp_path}/out").collect()) == [1, 2]
