"""Named queries that go through the library's DataFrame operators, and their SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carefold.functions.clinical import age_on, normal_name
from carefold.operators import recall
from carefold.operators.store import KeyedTable
from carefold.plans import clinic_sql
from carefold.plans.catalog import run
from carefold.plans.views import with_views
from carefold.sources import chart_files, fhir, lab_csv
from carefold.storage import shared_dir
from carefold.streaming import reconcile

TOP = 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recall_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    query = vectors.filter("vec_id = 0").select("embedding").first()
    found = recall.top_k(vectors, query[0] if query else [], TOP)
    return found.select(F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


def recall_topk_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every row whose id is divisible by 50, among all rows."""
    vectors = _table(spark, sf_dir, "embeddings")
    found = recall.top_k_each(vectors, vectors.filter("vec_id % 50 = 0"), TOP)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


#: A bundle of one laboratory result and one family history per order.
_BUNDLE = """
    SELECT id, to_json(named_struct('resourceType', 'Bundle', 'entry', array(
      named_struct('resource', named_struct('resourceType', 'Observation', 'effectiveDateTime', concat(CAST(valid_from AS STRING), 'T08:00:00Z'),
        'subject', named_struct('reference', concat('Patient/', CAST(patient_id AS STRING))), 'code', named_struct('text', concat(' ', upper(subject))),
        'valueQuantity', named_struct('value', reading, 'unit', 'mg/dL'), 'interpretation', array(named_struct('text', upper(flag))),
        'relationship', CAST(NULL AS STRUCT<text: STRING>), 'date', CAST(NULL AS STRING),
        'condition', CAST(NULL AS ARRAY<STRUCT<code: STRUCT<text: STRING>, onsetAge: STRUCT<value: BIGINT>>>))),
      named_struct('resource', named_struct('resourceType', 'FamilyMemberHistory', 'effectiveDateTime', CAST(NULL AS STRING),
        'subject', named_struct('reference', concat('Patient/', CAST(patient_id AS STRING))), 'code', CAST(NULL AS STRUCT<text: STRING>),
        'valueQuantity', CAST(NULL AS STRUCT<value: BIGINT, unit: STRING>), 'interpretation', CAST(NULL AS ARRAY<STRUCT<text: STRING>>),
        'relationship', named_struct('text', relation), 'date', substr(CAST(valid_from AS STRING), 1, 7),
        'condition', array(named_struct('code', named_struct('text', subject), 'onsetAge', named_struct('value', age_at_onset)),
                           named_struct('code', named_struct('text', 'stroke'), 'onsetAge', named_struct('value', 70L)))))))) AS value
    FROM v_fact"""


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders are dealt out before texts are made of them, as a file of them is few tasks' work."""
    facts = run(spark, sf_dir, "SELECT * FROM v_fact").repartition("id")
    return spark.sql(_BUNDLE.replace("FROM v_fact", "FROM {facts}"), facts=facts)


def fhir_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fhir.assertions(_bundles(spark, sf_dir)).filter("resource_type = 'LabResult'")
    return found.select("id", "subject", F.col("reading").cast("double").cast("long").alias("reading"), "unit", "flag", "valid_from", "patient_ref")


def fhir_family_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fhir.assertions(_bundles(spark, sf_dir)).filter("resource_type = 'FamilyHistory'")
    return found.select("id", "subject", "relation", F.col("age_at_onset").cast("long").alias("age_at_onset"), "valid_from")


def csv_labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, """
        SELECT CASE WHEN id % 6 = 0 THEN ' ' ELSE upper(subject) END AS ` Test `, CAST(reading AS STRING) AS Value, '' AS unit,
               flag AS Interpretation, CAST(valid_from AS STRING) AS date, CAST(patient_id AS STRING) AS Patient
        FROM v_fact WHERE resource_type = 'LabResult'""")  # fmt: skip
    return lab_csv.assertions(rows).select("subject", "reading", "unit", "flag", "valid_from", "patient_ref")


def patients_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = run(spark, sf_dir, "SELECT * FROM v_patient")
    age = age_on(F.col("dob"), F.lit("1998-06-30").cast("date"))
    return people.groupBy(normal_name(F.col("name")).alias("name")).agg(F.count("*").alias("patients"), F.max(age).alias("oldest"))


def stream_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays the events as a stream; the closed facts go to a table in the shared folder."""
    path = f"{sf_dir}/events.parquet"
    # As a pattern, the path may be a single file as well as a folder.
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/event[s].parquet")
    statements = events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("patient_id"), F.col("event_type").alias("subject"),
        F.floor(F.col("value") / 100).cast("long").alias("bucket"), F.to_date("ts").alias("valid_from"),
    )
    out = shared_dir(spark, "closed-facts")
    stream = reconcile.closed_facts(statements).writeStream.format("parquet").option("checkpointLocation", f"{out}-state")
    stream.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(reconcile.CLOSED).parquet(out)


def recall_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the neighbours of every row whose id is divisible by 50 the index finds."""
    vectors = _table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 50 = 0")
    return recall.found_share(recall.Index(vectors, TOP).search(asked), recall.top_k_each(vectors, asked, TOP))


def _half(broken: str) -> Column:
    """Files' contents, of which those where ``broken`` holds stop half-way."""
    return F.when(F.expr(broken), F.expr("substr(content, 1, CAST(length(content) / 2 AS INT))")).otherwise(F.col("content")).alias("content")


def _registry_files(spark: SparkSession, sf_dir: str) -> str:
    """The customers as registry files of fifty ids, a fourth of them in the users' own; every seventh file is broken."""
    to = shared_dir(spark, "registry-files")
    people = run(spark, sf_dir, """
        SELECT CAST(c_custkey AS STRING) AS patient_id, concat('MRN-', CAST(900000 + c_custkey AS STRING)) AS mrn, c_name AS name, CAST(NULL AS STRING) AS dob, '' AS sex, c_mktsegment AS summary,
               CAST(floor(c_custkey / 50) AS BIGINT) AS file, c_custkey % 4 = 0 AS by_user FROM customer""")  # fmt: skip
    files = chart_files.as_registry(people.filter("NOT by_user"), "seed").unionByName(chart_files.as_registry(people.filter("by_user"), "user"))
    chart_files.write_files(files.select("path", _half("CAST(regexp_extract(path, '([0-9]+)[.]json', 1) AS INT) % 7 = 3")), to)
    return to


def _chart_files(spark: SparkSession, sf_dir: str) -> str:
    """The documents as charts of five ids, three of each in one file and two as uploads; some files are broken."""
    to = shared_dir(spark, "chart-files")
    docs = run(spark, sf_dir, """
        SELECT CAST(CAST(floor(doc_id / 5) AS BIGINT) AS STRING) AS patient_id, doc_id % 5 > 2 AS uploaded,
               named_struct('doc_id', concat('D', lpad(CAST(doc_id AS STRING), 12, '0')), 'date', CAST(DATE '2020-01-01' + CAST(doc_id * 37 % 90 AS INT) AS STRING), 'title', source,
                            'text', text, 'uploaded', doc_id % 5 > 2) AS document FROM documents""")  # fmt: skip
    own, sent = chart_files.as_documents(docs.filter("NOT uploaded")), chart_files.as_uploads(docs.filter("uploaded"))
    own = own.select("path", _half("CAST(regexp_extract(path, '([0-9]+)/documents', 1) AS LONG) % 11 = 5"))
    sent = sent.select("path", _half("CAST(regexp_extract(path, 'D([0-9]+)[.]json', 1) AS LONG) % 13 = 4"))
    chart_files.write_files(own.unionByName(sent), to)
    return to


def registry_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart_files.registry(spark, _registry_files(spark, sf_dir)).select("ord", "source", "patient_id", "name", "mrn")


def chart_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chart_files.documents(spark, _chart_files(spark, sf_dir))
    return docs.select("patient_id", "place", "doc_id", "date", "uploaded", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def document_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice every id: half of them are nobody's document."""
    docs = chart_files.documents(spark, _chart_files(spark, sf_dir))
    asked = run(spark, sf_dir, "SELECT doc_id AS asked, concat('D', lpad(CAST(doc_id * 2 AS STRING), 12, '0')) AS doc_id FROM documents")
    return chart_files.document_by_id(asked, docs).select("asked", "doc_id", "patient_id", "date", "uploaded")


def unreadable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    people, docs = _registry_files(spark, sf_dir), _chart_files(spark, sf_dir)
    return chart_files.unreadable(spark, people).unionByName(chart_files.unreadable(spark, docs))


def ledger_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements as a stored table, then two merges in turn: corrections, then new rows and deletions."""
    said = run(spark, sf_dir, "SELECT id, patient_id, subject, bucket AS value, valid_from FROM v_state")
    table = KeyedTable.create(spark, shared_dir(spark, "ledger-table"), "id long, patient_id long, subject string, value long, valid_from date", "id", 16)
    table.merge(said)
    table.merge(said.filter("id % 40 = 0").withColumn("value", F.col("value") + 100))
    table.merge(said.filter("id % 50 = 1").withColumn("id", -F.col("id")), deleted=said.filter("id % 60 = 7").select("id"))
    return table.read()


def hash_index_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of uploads by content: all documents, then some of them again under another name; the last one stays."""
    docs = run(spark, sf_dir, "SELECT sha2(coalesce(text, ''), 256) AS hash, doc_id, CAST(floor(doc_id / 5) AS BIGINT) AS patient_id, concat('file-', CAST(doc_id AS STRING)) AS filename FROM documents")
    table = KeyedTable.create(spark, shared_dir(spark, "hash-table"), "hash string, doc_id long, patient_id long, filename string", "hash", 16)
    table.merge(docs, order=F.col("doc_id"))
    table.merge(docs.filter("doc_id % 10 = 0").withColumn("filename", F.concat(F.lit("again-"), "filename")), order=F.col("doc_id"))
    return table.read()


QUERIES = {
    "recall_topk": recall_topk,
    "recall_topk_each": recall_topk_each,
    "fhir_observation": fhir_observation,
    "fhir_family_history": fhir_family_history,
    "csv_labs": csv_labs,
    "patients_by_name": patients_by_name,
    "stream_reconcile": stream_reconcile,
    "recall_index": recall_index,
    "registry_files": registry_files,
    "chart_documents": chart_documents,
    "document_by_id": document_by_id,
    "unreadable_files": unreadable_files,
    "ledger_stored": ledger_stored,
    "hash_index_stored": hash_index_stored,
}

_CHART_DOCUMENT = """
    SELECT CAST(CAST(floor(doc_id / 5) AS BIGINT) AS VARCHAR) AS patient_id, row_number() OVER (PARTITION BY floor(doc_id / 5) ORDER BY doc_id * 37 % 90, doc_id % 5) AS place, concat('D', lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS doc_id,
           CAST(DATE '2020-01-01' + CAST(doc_id * 37 % 90 AS INT) AS VARCHAR) AS date, doc_id % 5 > 2 AS uploaded, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WHERE CASE WHEN doc_id % 5 > 2 THEN doc_id % 13 <> 4 ELSE floor(doc_id / 5) % 11 <> 5 END"""

ORACLE = {
    "recall_topk": f"""
        SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity
        FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
        ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id LIMIT {TOP}""",
    "recall_topk_each": f"""
        SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM (
            SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity
            FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) AS pairs) AS ranked WHERE place <= {TOP}""",
    "fhir_observation": """
        SELECT id, split_part(lower(subject), ' ', 1) AS subject, reading, 'mg/dL' AS unit, CASE flag WHEN 'high' THEN 'high' WHEN 'low' THEN 'low' ELSE flag END AS flag,
               valid_from, CAST(patient_id AS VARCHAR) AS patient_ref FROM v_fact""",
    "fhir_family_history": """
        SELECT id, subject, relation, age_at_onset, CAST(date_trunc('month', valid_from) AS DATE) AS valid_from FROM v_fact
        UNION ALL SELECT id, 'stroke', relation, 70, CAST(date_trunc('month', valid_from) AS DATE) FROM v_fact""",
    "csv_labs": """
        SELECT subject, CAST(reading AS VARCHAR) AS reading, CAST(NULL AS VARCHAR) AS unit, flag, valid_from, CAST(patient_id AS VARCHAR) AS patient_ref
        FROM v_fact WHERE resource_type = 'LabResult' AND id % 6 <> 0""",
    "patients_by_name": """
        SELECT regexp_replace(trim(replace(replace(lower(name), '''', ''), '-', ' ')), '\\s+', ' ', 'g') AS name, count(*) AS patients,
               max(1998 - year(dob) - CASE WHEN month(dob) * 100 + day(dob) > 630 THEN 1 ELSE 0 END) AS oldest
        FROM v_patient GROUP BY 1""",
    "registry_files": """
        SELECT row_number() OVER (ORDER BY c_custkey % 4 = 0, floor(c_custkey / 50), CAST(c_custkey AS VARCHAR)) AS ord, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS source,
               CAST(c_custkey AS VARCHAR) AS patient_id, c_name AS name, concat('MRN-', 900000 + c_custkey) AS mrn FROM customer WHERE floor(c_custkey / 50) % 7 <> 3""",
    "chart_documents": _CHART_DOCUMENT,
    "document_by_id": f"""
        SELECT d.doc_id AS asked, concat('D', lpad(CAST(d.doc_id * 2 AS VARCHAR), 12, '0')) AS doc_id, f.patient_id, f.date, f.uploaded
        FROM documents d LEFT JOIN ({_CHART_DOCUMENT}) f ON f.doc_id = concat('D', lpad(CAST(d.doc_id * 2 AS VARCHAR), 12, '0'))""",
    "unreadable_files": """
        SELECT 'registry' AS kind, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS source, count(DISTINCT floor(c_custkey / 50)) AS n FROM customer WHERE floor(c_custkey / 50) % 7 = 3 GROUP BY 1, 2
        UNION ALL SELECT 'documents', 1, count(*) FROM documents WHERE doc_id % 5 > 2 AND doc_id % 13 = 4 HAVING count(*) > 0
        UNION ALL SELECT 'documents', 0, count(DISTINCT floor(doc_id / 5)) FROM documents WHERE doc_id % 5 < 3 AND floor(doc_id / 5) % 11 = 5 HAVING count(*) > 0""",
    "ledger_stored": """
        SELECT id, patient_id, subject, bucket + CASE WHEN id % 40 = 0 THEN 100 ELSE 0 END AS value, valid_from FROM v_state WHERE id % 60 <> 7
        UNION ALL SELECT -id, patient_id, subject, bucket, valid_from FROM v_state WHERE id % 50 = 1""",
    "hash_index_stored": """
        SELECT sha256(coalesce(text, '')) AS hash, coalesce(max(doc_id) FILTER (WHERE doc_id % 10 = 0), max(doc_id)) AS doc_id, CAST(floor(coalesce(max(doc_id) FILTER (WHERE doc_id % 10 = 0), max(doc_id)) / 5) AS BIGINT) AS patient_id,
               concat(CASE WHEN count(*) FILTER (WHERE doc_id % 10 = 0) > 0 THEN 'again-' ELSE '' END, 'file-', coalesce(max(doc_id) FILTER (WHERE doc_id % 10 = 0), max(doc_id))) AS filename FROM documents GROUP BY 1""",
    "stream_reconcile": """
        SELECT f.patient_id, f.subject, f.id, f.value AS bucket, f.valid_from, f.valid_to, f.superseded_by, f.status,
               1 + (SELECT count(*) FROM o_verdict r WHERE r.cls = 'CONSISTENT' AND r.target = f.id) AS statements FROM o_ledger f WHERE f.status <> 'active'""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql, clinic_sql.VIEWS) for name, sql in ORACLE.items()}
