"""Steps whose work or memory once grew faster than their input."""

import datetime

from pyspark.sql import functions as F

from carefold.operators import checks, learned, terms
from carefold.plans import clinic, frames
from carefold.sources import fhir
from carefold.storage import shared_dir
from carefold.streaming import reconcile


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stream_calls_by_shards(spark, monkeypatch):
    """4,000 keys in two triggers: no more states than shards, and each key's facts of both triggers."""
    monkeypatch.setattr(reconcile, "SHARDS", 8)
    to = shared_dir(spark, "shards")
    for i in range(2):
        rows = spark.range(4000).selectExpr(f"id * 2 + {i} AS id", "id AS patient_id", "'x' AS subject", f"{i} * (id % 2) AS bucket", f"DATE '2024-01-01' + {i} AS valid_from")
        rows.coalesce(1).write.parquet(f"{to}/in/{i}")
    stream = spark.readStream.schema("id long, patient_id long, subject string, bucket long, valid_from date").option("maxFilesPerTrigger", 1).parquet(f"{to}/in/*")
    query = reconcile.closed_facts(stream).writeStream.format("memory").queryName("closed_by_shards").option("checkpointLocation", f"{to}/state")
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 8
    got = sorted((r.patient_id, r.id, r.superseded_by, r.status, str(r.valid_from), str(r.valid_to)) for r in spark.table("closed_by_shards").collect())
    assert got == [(p, 2 * p, 2 * p + 1, "superseded", "2024-01-01", "2024-01-02") for p in range(1, 4000, 2)]


def test_orders_are_not_broadcast(spark):
    """A small file of patients makes many orders and keys: they meet allergies in a shuffle."""
    assert "BroadcastExchange" not in plan(clinic.QUERIES["prescribe_screen"](spark, "/root/testdata/sf0.01")).split("hashpartitioning")[-1]
    drugs = spark.range(10).selectExpr("id AS patient_id", "'amoxicillin' AS drug")
    allergies = spark.createDataFrame([(3, 1, datetime.date(2020, 1, 1), "penicillin", "rash", "")], "patient_id long, allergy_id long, allergy_from date, substance string, reaction string, severity string")
    found = checks.conflicts(drugs, allergies)
    assert "BroadcastHashJoin" not in plan(found) and [r.patient_id for r in found.collect()] == [3]


def test_equal_candidates_are_judged_once(spark):
    facts = spark.range(1000).selectExpr("id", "'Medication' AS resource_type", "CASE WHEN id % 2 = 0 THEN 'amoxicilin' END AS value", "CAST(NULL AS STRING) AS drug", "CAST(NULL AS STRING) AS substance", "CAST(NULL AS STRING) AS analyte", "CAST(NULL AS STRING) AS condition")
    out = terms.ground(facts, spark.createDataFrame([("amoxicillin",)], "name string"))
    assert "/candidates-" in plan(out) and "posexplode_outer" not in plan(out)
    got = {(r.id % 2, r.grounded, r.name, r.distance) for r in out.collect()}
    assert got == {(0, True, "amoxicillin", 1), (1, None, None, None)}


def test_versions_of_a_term_do_not_multiply_rows(spark):
    """Versions meet the days asked in a window; none of them is joined by a range of days."""
    known = spark.range(500).selectExpr("'drug' AS kind", "'zornil' AS term", "CASE WHEN id % 2 = 0 THEN 'statin' ELSE 'nsaid' END AS class", "DATE '2000-01-01' + CAST(2 * id AS INT) AS day", "id AS seq")
    facts = spark.range(1100).selectExpr("id", "'drug' AS kind", "'Zornil' AS name", "DATE '1999-12-31' + CAST(id AS INT) AS day")
    out = learned.classify_on(facts, known)
    assert "since" not in plan(out).split("Window")[0]
    got = {r.id: r["class"] for r in out.collect()}
    assert got == {i: None if i < 1 else "statin" if min((i - 1) // 2, 499) % 2 == 0 else "nsaid" for i in range(1100)}


def test_texts_are_parsed_once(spark):
    texts = spark.createDataFrame([(1, '{"resourceType": "Condition", "code": {"text": " Asthma "}}'), (2, "no json"), (3, None)], "id long, value string")
    out = fhir.assertions(texts, F.to_date(F.lit("2024-01-01")))
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("parse") == 1
    assert [(r.id, r.subject) for r in out.collect()] == [(1, "asthma")]
    assert "hashpartitioning(id" in plan(frames.fhir_observation(spark, "/root/testdata/sf0.001"))
