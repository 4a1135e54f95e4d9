"""Named relational queries: one text for Spark and for the oracle, differing at most in function spellings.

Spellings that differ are written as ``@NAME[a|b|...]`` and translated by DIALECTS.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carefold.plans.views import tables_of, with_views
from carefold.vocabulary import DRUG_CLASSES

AS_OF = "DATE '2024-01-15'"
TODAY = "DATE '1998-06-30'"
NORMAL_NAME = "@REPLACE[trim(replace(replace(lower({0}), '''', ''), '-', ' '))|\\s+| ]"

QUERIES = {
    # The ledger and time travel.
    "snapshot_max_by": f"""
        SELECT patient_id, subject, max_by(bucket, event_key) AS bucket, max(valid_from) AS stated
        FROM (SELECT *, id AS event_key FROM v_state WHERE valid_from <= {AS_OF}) GROUP BY patient_id, subject""",
    "naive_vs_healed": """
        SELECT patient_id, subject, count(*) AS naive_facts, CAST(sum(opens) AS BIGINT) AS healed_facts FROM v_island_start GROUP BY patient_id, subject""",
    # The graph.
    "graph_edges_adjacent": """
        SELECT source, target, 'SAME_SUBJECT' AS kind FROM (
          SELECT id AS source, lead(id) OVER (PARTITION BY patient_id, resource_type, subject ORDER BY valid_from, id) AS target
          FROM v_fact WHERE status <> 'retracted') WHERE target IS NOT NULL""",
    # Checks and cards.
    "allergy_badge": """
        SELECT patient_id, @LISTAGG[subject|', '|subject] AS badge FROM (
          SELECT DISTINCT patient_id, subject FROM v_fact WHERE resource_type = 'Allergy' AND status = 'active' AND predicate <> 'cleared') GROUP BY patient_id""",
    "lab_series_scaled": """
        SELECT patient_id, subject, id, CASE WHEN high = low THEN 500 ELSE CAST(floor(1000 * (reading - low) / (high - low)) AS BIGINT) END AS per_mille
        FROM (SELECT *, min(reading) OVER (PARTITION BY patient_id, subject) AS low, max(reading) OVER (PARTITION BY patient_id, subject) AS high
              FROM v_fact WHERE resource_type = 'LabResult' AND status <> 'retracted')""",
    "timeline_points": "SELECT patient_id, valid_from, @LISTAGG[CAST(id AS STRING)|','|id] AS facts FROM v_fact WHERE status <> 'retracted' GROUP BY patient_id, valid_from",
    "last_visit": "SELECT p.patient_id, max(f.valid_from) AS last_visit FROM v_patient p LEFT JOIN v_fact f ON f.patient_id = p.patient_id GROUP BY p.patient_id",
    "ingested_documents": "SELECT doc_id, max_by(id, k) AS fact_id FROM (SELECT *, concat(CAST(valid_from AS STRING), lpad(CAST(id AS STRING), 12, '0')) AS k FROM v_fact) GROUP BY doc_id",
    # Identity, kinship and access.
    "access_scope": "SELECT doctor_id, count(*) AS patients, min(patient_id) AS first, max(patient_id) AS last FROM v_access GROUP BY doctor_id",
    "normalized_names": f"SELECT patient_id, {NORMAL_NAME.format('name')} AS name FROM v_patient",
    "age_years": f"""
        SELECT patient_id, year({TODAY}) - year(dob) - CASE WHEN month(dob) * 100 + day(dob) > month({TODAY}) * 100 + day({TODAY}) THEN 1 ELSE 0 END AS age FROM v_patient""",
    # Dedup and idempotency.
    "upload_dedup": "SELECT hash, min(doc_id) AS doc_id, count(*) AS uploads FROM (SELECT doc_id, @SHA[text] AS hash FROM documents) GROUP BY hash",
    "idempotent_keys": "SELECT @SHA[concat(lower(trim(role)), chr(31), lower(trim(text)))] AS write_key, count(*) AS writes, min(conv_id) AS first FROM conversations GROUP BY 1",
    # Scalar functions.
    # Evidence, conversation, audit, recall.
    "thread_list": "SELECT conv_id, min_by(substr(text, 1, 60), turn) AS title, count(*) AS messages FROM conversations GROUP BY conv_id",
    "message_replay": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) WHERE place <= 20",
    "audit_recent": "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 100",
    "audit_by_actor": "SELECT user_id, event_type, count(*) AS actions, min(event_id) AS first FROM events GROUP BY user_id, event_type",
}

DIALECTS = {
    "spark": {
        "LISTAGG": "listagg({0}, {1}) WITHIN GROUP (ORDER BY {2})",
        "DAYS": "datediff({1}, {0})",
        "REPLACE": "regexp_replace({0}, r'{1}', '{2}')",
        "SHA": "sha2({0}, 256)",
        "LINES": r"posexplode(split({0}, '\n')) AS (place, line)",
        "WORDS": "explode(split({0}, ' '))",
    },
    "duckdb": {
        "LISTAGG": "string_agg({0}, {1} ORDER BY {2})",
        "DAYS": "date_diff('day', {0}, {1})",
        "REPLACE": "regexp_replace({0}, '{1}', '{2}', 'g')",
        "SHA": "sha256({0})",
        "LINES": "generate_subscripts(string_split({0}, chr(10)), 1) - 1 AS place, unnest(string_split({0}, chr(10))) AS line",
        "WORDS": "unnest(string_split({0}, ' '))",
    },
}


def spelled(sql: str, dialect: str) -> str:
    """``sql`` with its ``@NAME[...]`` in the dialect's spelling; brackets within arguments may nest in pairs."""
    while m := re.search(r"@(\w+)\[", sql):
        depth, end = 1, m.end()
        while depth:
            depth += {"[": 1, "]": -1}.get(sql[end], 0)
            end += 1
        arguments = [a if a.isspace() else a.strip() for a in sql[m.end() : end - 1].split("|")]
        sql = sql[: m.start()] + DIALECTS[dialect][m[1]].format(*arguments) + sql[end:]
    return sql


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a query of the catalog's form over the tables it names."""
    text = spelled(with_views(sql), "spark").replace("regexp_matches(", "regexp_like(")
    found = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in tables_of(text)}
    text = text.replace("{", "{{").replace("}", "}}")  # braces of the text are not placeholders
    for name in found:
        text = re.sub(rf"\b(FROM|JOIN)(\s+){name}\b", rf"\1\2{{{name}}} AS {name}", text)
    return spark.sql(text, **found)


def queries(of: dict[str, str] = QUERIES) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, sql=sql: run(spark, sf_dir, sql) for name, sql in of.items()}


def oracle_sql(of: dict[str, str] = QUERIES) -> dict[str, str]:
    return {name: spelled(with_views(sql), "duckdb").replace("regexp_like(", "regexp_matches(") for name, sql in of.items()}


#: For callers who want the vocabulary without a session.
DRUGS = sorted(d for drugs in DRUG_CLASSES.values() for d in drugs)
