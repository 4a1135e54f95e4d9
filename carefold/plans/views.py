"""Clinical views over the driver's tables, as SQL that Spark and DuckDB both run.

The driver's tables hold no clinical rows, so every operator works on these deterministic projections of them.
A view is text with the names of the views that it needs; ``with_views`` puts together the common table
expressions that a query uses, so that one text serves the Spark query and its oracle.
"""

from __future__ import annotations

import re

from carefold.vocabulary import CROSS_REACTIVE, DRUG_CLASS, DRUG_CLASSES, FAMILY_RISK, FIRST_DEGREE, HEREDITARY

ANALYTES = ["hba1c", "ldl", "creatinine", "inr"]
RELATIONS = [*FIRST_DEGREE, "uncle", "grandmother"]
#: Conditions of charts that no family risk comes from.
OTHER_CONDITIONS = ["hypertension", "asthma", "pneumonia"]

# What charts are made of; some of it is in no vocabulary.
CHART_ANALYTES = ["hba1c", "ldl", "creatinine", "inr", "potassium", "egfr", "ferritin"]
CHART_CONDITIONS = [*FAMILY_RISK, "heart attack (myocardial infarction)", "Type 2 Diabetes mellitus", "hypertension", "asthma", "chronic kidney disease"]
CHART_DRUGS = [*DRUG_CLASS, "zinc", "peanut oil", "latex"]
CHART_RELATIONS = [*FIRST_DEGREE, "Mother ", "uncle", "aunt"]
CHART_EVENTS = ["Renal ultrasound", "endocrinology consult", "HbA1c review", "appendectomy", "electrolyte panel", "ferritin infusion", "warfarin plan"]
# What functions of single texts are tried on.
RAW_NAMES = ["HbA1c", " Glycated Hb", "LDL cholesterol", "VLDL", "HDL-C", "Triglycerides", "Total Cholesterol", "Creatinine, serum", "eGFR", "Potassium", "Sodium", "INR (PT)", "Glucose fasting", "BMI", "Ferritin ng", "A1C "]
RAW_FLAGS = ["H", "l", " High ", "hemolyzed", "Low", "", "CRITICAL"]
RAW_DATES = ["2001-02-03", "2001-02-03T10:00:00", "2001-02", "2001", " 2001-02-03 ", "2001-13-40", "soon", "", "20010203", "x2001"]
OTHER_RAW = ["7.8", " 12 ", "nan", "inf", "-Infinity", "1e3", "within limits", "", "5 mg"]
CHART_HABITS = ["smokes daily", "non-smoker", "never smoked", "quit smoking", "weekly walks"]


def _values(rows: list[tuple]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in rows)


_DRUGS = [(i, d, c) for i, (d, c) in enumerate((d, c) for c, ds in DRUG_CLASSES.items() for d in ds)]
_CONDITIONS = [(i, c, g) for i, (c, g) in enumerate((c, g) for g, cs in HEREDITARY.items() for c in cs)]


def pick(values: list[str], n: str) -> str:
    """SQL: the n-th of the values, counted from 0 and again from the start after the last."""
    joined = "|".join(values).replace("'", "''")
    return f"split_part('{joined}', '|', CAST({n} % {len(values)} + 1 AS INT))"


#: Digits of an order's key, by which its row of the chart is made.
_D, _T, _H = "o_orderkey % 10", "CAST(floor(o_orderkey / 10) AS BIGINT)", "CAST(floor(o_orderkey / 7) AS BIGINT)"
_DRUG_NAMES = [d for _, d, _ in _DRUGS]
_CONDITION_NAMES = [c for _, c, _ in _CONDITIONS]

VIEWS = {
    "d_drug": f"SELECT n, drug, class FROM (VALUES {_values(_DRUGS)}) AS t(n, drug, class)",
    "d_group": f"SELECT class, grp FROM (VALUES {_values([(c, g) for g, cs in CROSS_REACTIVE.items() for c in cs])}) AS t(class, grp)",
    "d_condition": f"SELECT n, cond, category FROM (VALUES {_values(_CONDITIONS)}) AS t(n, cond, category)",
    "d_analyte": f"SELECT n, analyte FROM (VALUES {_values(list(enumerate(ANALYTES)))}) AS t(n, analyte)",
    # Three patients share each name, at any size; a family of 39 ids shares its surname.
    "v_patient": """
      SELECT c_custkey AS patient_id, concat('MRN-', CAST(900000 + c_custkey AS STRING)) AS mrn,
             concat('Given-', CAST(c_custkey % 13 AS STRING), ' O''Fam', CAST(CAST(floor(c_custkey / 39) AS BIGINT) AS STRING)) AS name,
             CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE DATE '1940-01-01' + CAST(c_custkey * 7919 % 25000 AS INT) END AS dob,
             c_nationkey AS nation
      FROM customer""",
    "v_fact": f"""
      SELECT o_orderkey AS id, o_custkey AS patient_id, CAST(o_orderdate AS DATE) AS valid_from,
             CASE WHEN {_D} < 4 THEN 'LabResult' WHEN {_D} < 6 THEN 'Medication'
                  WHEN {_D} = 6 THEN 'Allergy' WHEN {_D} = 7 THEN 'Condition'
                  WHEN {_D} = 8 THEN 'FamilyHistory' ELSE 'Lifestyle' END AS resource_type,
             CASE WHEN {_D} < 4 THEN {pick(ANALYTES, "o_orderkey")} WHEN {_D} < 7 THEN {pick(_DRUG_NAMES, "o_orderkey")}
                  WHEN {_D} = 7 THEN {pick(_CONDITION_NAMES + OTHER_CONDITIONS, _T)}
                  WHEN {_D} = 8 THEN {pick(_CONDITION_NAMES, _T)} ELSE 'smoking' END AS subject,
             CASE WHEN {_D} = 6 AND o_orderkey % 7 = 0 THEN 'cleared' WHEN {_D} = 4 AND {_T} % 5 = 0 THEN 'stopped'
                  WHEN {_D} < 4 THEN 'measured' WHEN {_D} < 6 THEN 'prescribed' ELSE 'reported' END AS predicate,
             CAST(floor(o_totalprice) AS BIGINT) AS reading,
             CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'normal' END AS flag,
             {pick(RELATIONS, _H)} AS relation, CAST(30 + {_H} % 50 AS BIGINT) AS age_at_onset,
             CASE WHEN o_orderkey % 23 = 0 THEN 'retracted' WHEN o_orderkey % 29 = 0 THEN 'contested' ELSE 'active' END AS status,
             CAST(floor(o_orderkey / 5) AS BIGINT) AS doc_id, CAST(1 + o_orderkey % 4 AS BIGINT) AS page
      FROM orders""",
    # Charts with every kind of fact, in the form that the operators take.
    "v_order": f"""
      SELECT o_orderkey AS id, o_custkey AS patient_id, CAST(o_orderdate AS DATE) AS valid_from, {_D} AS d, {_T} AS t, {_H} AS h,
             CAST(floor(o_totalprice / 10000) AS DOUBLE) / 2 AS half, o_orderpriority AS priority,
             CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 40 ELSE CAST(floor(o_custkey / 39) AS BIGINT) * 39 + o_orderkey % 39 END AS relative
      FROM orders""",
    "v_chart": f"""
      SELECT id, patient_id, valid_from,
             CASE WHEN d < 4 THEN 'LabResult' WHEN d < 6 THEN 'Medication' WHEN d = 6 THEN 'Allergy' WHEN d = 7 THEN 'Condition'
                  WHEN d = 8 THEN 'FamilyHistory' WHEN t % 5 = 0 THEN 'Procedure' WHEN t % 5 = 2 THEN 'Vital' WHEN t % 5 > 2 THEN 'Lifestyle' END AS resource_type,
             CASE WHEN d < 4 THEN concat('lab ', {pick(CHART_ANALYTES, "t")}) WHEN d < 6 THEN 'medication' WHEN d = 6 THEN 'allergy' WHEN d = 7 THEN 'diagnosis'
                  WHEN d = 8 THEN 'family' WHEN t % 5 = 0 THEN 'procedure' WHEN t % 5 = 1 THEN {pick(["note", "Plan", "memo"], "h")} WHEN t % 5 = 2 THEN 'vital' ELSE 'lifestyle' END AS subject,
             CASE WHEN d < 4 THEN 'measured' WHEN d < 6 THEN {pick(["prescribed", "switched", "stopped"], "h")} WHEN d = 6 THEN {pick(["diagnosed", "diagnosed", " Cleared"], "h")}
                  WHEN d = 7 THEN {pick(["diagnosed", "resolved"], "h")} ELSE 'reported' END AS predicate,
             CASE WHEN d < 4 THEN CASE WHEN id % 13 = 0 THEN 'within limits' ELSE concat({pick(CHART_ANALYTES, "t")}, ' reading') END
                  WHEN d < 6 THEN concat({pick(CHART_DRUGS, "id")}, {pick(["", " 500mg", "/clavulanate", " XR 5 mg"], "t")})
                  WHEN d = 6 THEN {pick(CHART_DRUGS, "h")} WHEN d = 7 OR d = 8 THEN concat({pick(["", "Suspected ", "severe "], "h")}, {pick(CHART_CONDITIONS, "t")})
                  WHEN t % 5 < 2 THEN {pick(CHART_EVENTS, "h")} WHEN t % 5 = 2 THEN 'blood pressure 120/80' ELSE {pick(CHART_HABITS, "h")} END AS value,
             CASE WHEN id % 23 = 0 THEN 'retracted' WHEN id % 29 = 0 THEN 'contested' WHEN id % 19 = 0 THEN 'superseded' ELSE 'active' END AS status,
             CASE WHEN id % 29 = 0 THEN 0.5 WHEN id % 31 = 0 THEN 0.55 ELSE 0.9 END AS confidence,
             {pick(["Dr. Ames", "Dr. Bell", "unknown"], "id")} AS source,
             CASE WHEN id % 17 <> 0 THEN CAST(floor(id / 5) AS BIGINT) END AS source_document,
             CASE WHEN id % 3 = 0 THEN concat('Visit ', CAST(CAST(floor(id / 5) AS BIGINT) AS STRING)) WHEN id % 3 = 1 THEN '' END AS document_title, CAST(1 + id % 4 AS BIGINT) AS page,
             CASE WHEN d < 4 THEN {pick(CHART_ANALYTES, "t")} END AS analyte, CASE WHEN d < 4 AND id % 13 <> 0 THEN half END AS reading,
             CASE WHEN d < 4 THEN {pick(["", "high", "Critical ", "therapeutic", "abnormal", "low"], "CAST(substr(priority, 1, 1) AS INT)")} END AS abnormal_flag,
             CASE WHEN d IN (4, 5) AND id % 7 <> 0 THEN concat({pick(CHART_DRUGS, "id")}, {pick(["", " 500mg", "/clavulanate", " XR 5 mg"], "t")}) END AS drug,
             CASE WHEN d = 6 AND id % 4 <> 0 THEN {pick(CHART_DRUGS, "h")} END AS substance, CASE WHEN d = 6 THEN {pick(["", "rash", "anaphylaxis"], "h")} END AS reaction,
             CASE WHEN d = 6 THEN {pick(["severe", "", "mild"], "t")} END AS severity,
             CASE WHEN d IN (7, 8) AND id % 7 <> 0 THEN concat({pick(["", "Suspected ", "severe "], "h")}, {pick(CHART_CONDITIONS, "t")}) END AS condition,
             CASE WHEN d = 8 THEN {pick(CHART_RELATIONS, "h")} END AS relation, CASE WHEN d = 8 AND h % 6 <> 0 THEN CAST(30 + h % 50 AS BIGINT) END AS age_at_onset,
             CASE WHEN d = 8 AND h % 9 <> 0 THEN concat('GIVEN-', CAST(relative % 13 AS STRING), '  O''Fam', CAST(CAST(floor(relative / 39) AS BIGINT) AS STRING)) END AS relative_name,
             CASE WHEN d = 8 AND h % 4 = 0 THEN DATE '1940-01-01' + CAST(relative * 7919 % 25000 AS INT) END AS relative_dob,
             CASE WHEN d = 8 AND h % 10 = 0 THEN concat(' mrn-', CAST(900000 + relative AS STRING)) END AS relative_mrn,
             CASE WHEN d = 9 AND t % 5 > 2 THEN {pick(["smoking", "exercise", "habits"], "id")} END AS factor
      FROM v_order""",
    # Names, flags, dates and numbers of all orders as they may be written.
    "v_raw": f"""
      SELECT id, concat({pick(RAW_NAMES, "t")}, CASE WHEN id % 3 = 0 THEN concat(' ', CAST(id % 50 AS STRING)) ELSE '' END) AS raw_name,
             CASE id % 3 WHEN 0 THEN {pick(RAW_FLAGS, "t")} WHEN 1 THEN concat(' ', substr(priority, 3)) ELSE substr(priority, 3, 1) END AS raw_flag,
             CASE id % 6 WHEN 0 THEN CAST(valid_from AS STRING) WHEN 1 THEN substr(CAST(valid_from AS STRING), 1, 7) WHEN 2 THEN substr(CAST(valid_from AS STRING), 1, 4)
                  WHEN 3 THEN concat(' ', CAST(valid_from AS STRING), 'T10:00:00') WHEN 4 THEN concat('x', CAST(valid_from AS STRING)) ELSE {pick(RAW_DATES, "t")} END AS raw_date,
             CASE id % 4 WHEN 0 THEN CAST(half AS STRING) WHEN 1 THEN concat(' ', CAST(t AS STRING)) WHEN 2 THEN concat(CAST(t AS STRING), ' mg') ELSE {pick(OTHER_RAW, "t")} END AS raw_number
      FROM v_order""",
    # Charts whose names are misspelt in every second row: a letter lost, or one too many.
    "v_misspelt": "SELECT id, resource_type, " + ", ".join(f"CASE id % 4 WHEN 1 THEN concat(substr({c}, 1, 2), substr({c}, 4)) WHEN 2 THEN concat(substr({c}, 1, 3), 'x', substr({c}, 4)) ELSE {c} END AS {c}" for c in ("value", "drug", "substance", "analyte", "condition")) + " FROM v_chart",
    "v_state": """
      SELECT event_id AS id, user_id AS patient_id, event_type AS subject, CAST(floor(value / 100) AS BIGINT) AS bucket, CAST(ts AS DATE) AS valid_from
      FROM events""",
    "v_island_start": """
      SELECT *, CASE WHEN bucket = lag(bucket) OVER (PARTITION BY patient_id, subject ORDER BY valid_from, id) THEN 0 ELSE 1 END AS opens
      FROM v_state""",
    "v_island_of": """
      SELECT *, sum(opens) OVER (PARTITION BY patient_id, subject ORDER BY valid_from, id) AS island FROM v_island_start""",
    "v_island": """
      SELECT patient_id, subject, island, min(id) AS id, min(bucket) AS bucket, min(valid_from) AS valid_from, count(*) AS statements
      FROM v_island_of GROUP BY patient_id, subject, island""",
    "v_ledger": """
      SELECT id, patient_id, subject, bucket, statements, valid_from,
             lead(valid_from) OVER (PARTITION BY patient_id, subject ORDER BY island) AS valid_to,
             lead(id) OVER (PARTITION BY patient_id, subject ORDER BY island) AS superseded_by
      FROM v_island""",
    "v_doctor": """
      SELECT s_suppkey AS doctor_id, s_nationkey AS nation, s_name AS doctor FROM supplier""",
    "v_access": """
      SELECT DISTINCT doctor_id, c_custkey AS patient_id FROM v_doctor JOIN customer ON c_nationkey = nation AND c_custkey % 10 = doctor_id % 10""",
    "v_drug_key": """
      SELECT drug, concat('class ', class) AS react FROM d_drug UNION ALL SELECT drug, concat('group ', grp) FROM d_drug JOIN d_group ON d_group.class = d_drug.class""",
    "v_allergy_card": """
      SELECT DISTINCT m.id AS fact_id, a.id AS evidence_id
      FROM (SELECT patient_id, id, react FROM v_fact JOIN v_drug_key ON drug = subject WHERE resource_type = 'Medication' AND status = 'active' AND predicate <> 'stopped') m
      JOIN (SELECT patient_id, id, react FROM v_fact JOIN v_drug_key ON drug = subject WHERE resource_type = 'Allergy' AND status = 'active' AND predicate <> 'cleared') a
        ON m.patient_id = a.patient_id AND m.react = a.react""",
    "v_episode": """
      SELECT *, lead(valid_from) OVER (PARTITION BY patient_id, resource_type, subject ORDER BY valid_from, id) AS valid_to,
             lead(id) OVER (PARTITION BY patient_id, resource_type, subject ORDER BY valid_from, id) AS next_id
      FROM v_fact WHERE status <> 'retracted'""",
    "v_edge": """
      SELECT id AS source, next_id AS target, 'SAME_SUBJECT' AS kind FROM v_episode WHERE next_id IS NOT NULL
      UNION ALL SELECT fact_id, evidence_id, 'CONFLICTS' FROM v_allergy_card""",
    "v_decision": """
      SELECT event_id AS seq, user_id AS pending_id, CASE WHEN event_type = 'error' THEN 'reject' ELSE 'approve' END AS decision FROM events""",
    "v_first_decision": "SELECT pending_id, min(seq) AS first FROM v_decision GROUP BY pending_id",
    # Names that become known in time: every second one is a condition, and every third one is learned anew later.
    "v_learned_name": f"""
      SELECT p_partkey AS seq, CASE WHEN p_partkey % 2 = 0 THEN 'drug' ELSE 'condition' END AS kind, lower(p_name) AS term, DATE '1992-06-01' + CAST(p_partkey * 11 % 2000 AS INT) AS day,
             CASE WHEN p_partkey % 14 < 2 THEN 'no known class' WHEN p_partkey % 2 = 0 THEN {pick(list(DRUG_CLASSES), "p_partkey")} ELSE {pick(list(HEREDITARY), "p_partkey")} END AS class,
             CASE WHEN p_partkey % 2 = 0 THEN {pick(list(DRUG_CLASSES), "CAST(floor(p_partkey / 3) AS BIGINT)")} ELSE {pick(list(HEREDITARY), "CAST(floor(p_partkey / 3) AS BIGINT)")} END AS later
      FROM part""",
    "v_learned": """
      SELECT seq, kind, term, class, day FROM v_learned_name UNION ALL SELECT -seq, kind, term, later, day + 400 FROM v_learned_name WHERE seq % 3 = 0""",
    "v_named": f"""
      SELECT o_orderkey AS id, n.kind, CASE WHEN o_orderkey % 5 = 0 THEN concat(' ', {pick(CHART_DRUGS + CHART_CONDITIONS, "o_orderkey")}) WHEN n.kind = 'drug' THEN concat(n.term, ' 50mg')
             WHEN o_orderkey % 3 = 0 THEN concat('Severe ', n.term, ' with stroke') ELSE n.term END AS name, CAST(o_orderdate AS DATE) AS day
      FROM orders JOIN v_learned_name n ON n.seq = o_orderkey % 199 + 1""",
    "v_term": """
      SELECT p_partkey AS seq, lower(p_name) AS term, CASE WHEN p_partkey % 6 = 0 THEN 'no known class' ELSE class END AS class
      FROM part JOIN d_drug ON n = p_partkey % 41""",
}


def with_views(body: str, more: dict[str, str] | None = None) -> str:
    """``body`` preceded by the common table expressions it needs, in order of need; ``more`` may be recursive."""
    views = VIEWS | (more or {})
    order: list[str] = []

    def need(sql: str, within: str = "") -> None:
        for name in views:
            if name not in order and name != within and re.search(rf"\b{name}\b", sql):
                need(views[name], name)
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body
    return f"WITH {'RECURSIVE ' if more else ''}" + ",\n".join(f"{name} AS ({views[name]})" for name in order) + "\n" + body


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def tables_of(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql)]
