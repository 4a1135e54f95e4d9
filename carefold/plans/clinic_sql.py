"""SQL for another engine (DuckDB) of the queries in ``clinic``, written from what they are to compute.

Views whose names begin with o_ are for this engine only. Reconciliation is a recursion over each key's statements,
kinship compares every candidate, text rules look words up in tables: nothing here follows the Spark plans.
"""

from __future__ import annotations

from carefold import vocabulary as V
from carefold.plans.views import _values, with_views

AS_OF, TODAY = "DATE '2024-01-15'", "DATE '1998-06-30'"


def _table(name: str, columns: str, rows: list[tuple]) -> str:
    return f"SELECT {columns} FROM (VALUES {_values(rows)}) AS {name}({columns})"


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _sentence(raw: str) -> str:
    """Letters after anything else in upper case, all others in lower case."""
    return f"list_aggregate(list_transform(regexp_extract_all(lower({raw}), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), 'string_agg', '')"


_ANALYTES_WATCHED = sorted({a for rules in V.MONITORING.values() for a, _ in rules})
_FILLED_CONDITION = "coalesce(nullif(condition, ''), value)"
_FILLED_DRUG = "trim(coalesce(nullif(drug, ''), value))"
_SUBSTANCE = "trim(coalesce(nullif(substance, ''), nullif(drug, ''), value))"
_NN = "trim(regexp_replace(replace(replace(lower({0}), '''', ''), '-', ' '), '\\s+', ' ', 'g'))"

VIEWS = {
    # Words of texts, and what the vocabulary has for them.
    "o_text": f"""
        SELECT DISTINCT text FROM (SELECT value AS text FROM v_chart UNION SELECT {_FILLED_DRUG} FROM v_chart UNION SELECT {_SUBSTANCE} FROM v_chart UNION SELECT {_FILLED_CONDITION} FROM v_chart
          UNION SELECT analyte FROM v_chart UNION SELECT 'amoxicillin 500mg' UNION SELECT 'azithromycin' UNION SELECT 'zinc') WHERE text IS NOT NULL""",
    "o_word": r"SELECT text, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM (SELECT text, regexp_split_to_array(replace(lower(trim(text)), '/', ' '), '\s+') AS w FROM o_text)",
    "o_class": """
        SELECT text, class, grp FROM (SELECT text, arg_min(class, place) AS class FROM (
          SELECT text, class, 0 AS place FROM o_text JOIN d_drug ON drug = lower(trim(text)) UNION ALL SELECT text, class, place FROM o_word JOIN d_drug ON drug = word) GROUP BY text)
        LEFT JOIN d_group USING (class)""",
    "o_risk": "SELECT text, arg_max(category, length(cond) * 100 - n) AS category FROM o_text JOIN d_condition ON contains(lower(trim(text)), cond) GROUP BY text",
    # The ledger: the verdict on each statement follows from the active fact (a_id, a_val, a_day) before it.
    "o_said": "SELECT *, row_number() OVER (PARTITION BY patient_id, subject ORDER BY valid_from, id) AS n FROM v_state",
    "o_verdict": """
        SELECT n, patient_id, subject, id, bucket, valid_from, 'NEW' AS cls, CAST(NULL AS BIGINT) AS target, id AS a_id, bucket AS a_val, valid_from AS a_day FROM o_said WHERE n = 1
        UNION ALL
        SELECT s.n, s.patient_id, s.subject, s.id, s.bucket, s.valid_from,
               CASE WHEN a_id IS NULL THEN 'NEW' WHEN s.bucket = a_val THEN 'CONSISTENT' WHEN s.valid_from = a_day THEN 'CONTRADICTS' ELSE 'SUPERSEDES' END, a_id,
               CASE WHEN a_id IS NULL OR s.bucket <> a_val AND s.valid_from <> a_day THEN s.id WHEN s.bucket = a_val THEN a_id END,
               CASE WHEN a_id IS NULL OR s.bucket <> a_val AND s.valid_from <> a_day THEN s.bucket WHEN s.bucket = a_val THEN a_val END,
               CASE WHEN a_id IS NULL OR s.bucket <> a_val AND s.valid_from <> a_day THEN s.valid_from WHEN s.bucket = a_val THEN a_day END
        FROM o_verdict v JOIN o_said s ON s.patient_id = v.patient_id AND s.subject = v.subject AND s.n = v.n + 1""",
    "o_ledger": """
        SELECT f.id, f.patient_id, f.subject, f.bucket AS value, f.valid_from, s.valid_from AS valid_to, s.id AS superseded_by,
               CASE WHEN f.cls = 'CONTRADICTS' OR c.id IS NOT NULL THEN 'contested' WHEN s.id IS NOT NULL THEN 'superseded' ELSE 'active' END AS status,
               least(80 + 5 * (SELECT count(*) FROM o_verdict r WHERE r.cls = 'CONSISTENT' AND r.target = f.id), CASE WHEN f.cls = 'CONTRADICTS' OR c.id IS NOT NULL THEN 50 ELSE 100 END) AS percent,
               CASE WHEN f.id % 7 = 0 THEN 'corrected' END AS reason, concat('log ', f.id % 3) AS source, concat(f.subject, ' ', f.bucket) AS label
        FROM o_verdict f LEFT JOIN o_verdict s ON s.target = f.id AND s.cls = 'SUPERSEDES' LEFT JOIN o_verdict c ON c.target = f.id AND c.cls = 'CONTRADICTS'
        WHERE f.cls <> 'CONSISTENT'""",
    "o_chain": """
        SELECT id AS start, 0 AS step, id, superseded_by AS next FROM o_ledger
        UNION ALL SELECT c.start, c.step + 1, l.id, l.superseded_by FROM o_chain c JOIN o_ledger l ON l.id = c.next""",
    # Of each fact the last one of its chain, and how many come before it.
    "o_rank": """
        SELECT e.start AS id, e.id AS chain, 1 + (SELECT max(b.step) FROM o_chain b WHERE b.id = e.start) AS position, 1 + (SELECT max(b.step) FROM o_chain b WHERE b.id = e.id) AS length
        FROM o_chain e WHERE e.next IS NULL""",
    # Kinship.
    "o_person": f"SELECT patient_id, name, {_NN.format('name')} AS nn, dob, lower(trim(mrn)) AS mrn, mrn AS shown_mrn, regexp_extract({_NN.format('name')}, '[^ ]+$') AS surname FROM v_patient",
    "o_mention": f"""
        SELECT id AS fact_id, patient_id, valid_from, lower(trim(relation)) AS relation, {_NN.format("coalesce(relative_name, '')")} AS nn, relative_dob AS dob, lower(trim(relative_mrn)) AS mrn
        FROM v_chart WHERE resource_type = 'FamilyHistory' AND status <> 'retracted' AND lower(trim(relation)) IN {_in(V.FIRST_DEGREE)}
          AND (coalesce(trim(relative_name), '') <> '' OR coalesce(trim(relative_mrn), '') <> '')""",
    "o_candidate": f"""
        SELECT m.*, p.patient_id AS rid, CASE WHEN p.mrn = m.mrn THEN 1 WHEN p.nn = m.nn AND p.dob = m.dob THEN 2 ELSE 3 END AS tier, p.surname = me.surname AS kin,
               CASE WHEN relation IN {_in(V.PARENTS)} THEN year(me.dob) - year(p.dob) BETWEEN 12 AND 70 WHEN relation IN {_in(V.CHILDREN)} THEN year(p.dob) - year(me.dob) BETWEEN 12 AND 70
                    ELSE abs(year(me.dob) - year(p.dob)) <= 30 END AS fits
        FROM o_mention m JOIN o_person me ON me.patient_id = m.patient_id JOIN o_person p ON p.patient_id <> m.patient_id AND (p.mrn = m.mrn OR (p.nn = m.nn AND m.nn <> ''))""",
    "o_match": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY tier, coalesce(fits, false) DESC, rid) AS place, count(*) OVER (PARTITION BY fact_id, tier, coalesce(fits, false)) AS tied
                       FROM o_candidate WHERE tier < 3 OR coalesce(fits, true)) WHERE place = 1""",
    "o_kin": "SELECT fact_id, patient_id, valid_from, relation, rid, CASE WHEN tier < 3 OR (tied = 1 AND kin AND coalesce(fits, false)) THEN 'high' ELSE 'medium' END AS confidence FROM o_match",
    "o_edge": f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY valid_from, fact_id, way) AS place FROM (
          SELECT patient_id AS a, rid AS b, relation, confidence, valid_from, fact_id, 0 AS way FROM o_kin
          UNION ALL SELECT rid, patient_id, CASE WHEN relation IN {_in(V.PARENTS)} THEN 'child' WHEN relation IN {_in(V.CHILDREN)} THEN 'parent' ELSE 'sibling' END, confidence, valid_from, fact_id, 1 FROM o_kin))
        WHERE place = 1""",
    # Checks.
    "o_lab": "SELECT *, lower(trim(abnormal_flag)) IN ('high', 'low', 'abnormal', 'critical') AS bad FROM v_chart WHERE resource_type = 'LabResult' AND status <> 'retracted' AND analyte <> ''",
    "o_series": f"""
        SELECT patient_id, analyte, min(valid_from) FILTER (WHERE bad AND reading IS NOT NULL) AS since, max(valid_from) FILTER (WHERE bad AND reading IS NOT NULL) AS until,
               string_agg(printf('%g', reading), ' → ' ORDER BY valid_from, id) FILTER (WHERE bad AND reading IS NOT NULL) AS moved, string_agg(id, ',' ORDER BY valid_from, id) FILTER (WHERE bad AND reading IS NOT NULL) AS ids,
               count(*) FILTER (WHERE bad AND reading IS NOT NULL) AS n, first(reading ORDER BY valid_from, id) FILTER (WHERE bad AND reading IS NOT NULL) AS a, last(reading ORDER BY valid_from, id) FILTER (WHERE bad AND reading IS NOT NULL) AS z,
               last(id ORDER BY valid_from, id) FILTER (WHERE bad) AS latest, max(valid_from) FILTER (WHERE bad) AS latest_from, max(valid_from) AS last_lab, min(struct_pack(d := valid_from, i := id)) AS seen
        FROM o_lab GROUP BY patient_id, analyte HAVING count(*) FILTER (WHERE bad) > 0""",
    "o_judged": f"SELECT *, n > 1 AND a <> z AND (z > a) = (analyte IN {_in(V.RISING_BAD)}) AS worse FROM o_series",
    "o_trend_card": """
        SELECT patient_id, concat('followup_gap:trend:', analyte) AS check_id, 'warning' AS indicator, concat(upper(analyte), CASE WHEN z > a THEN ' rising: ' ELSE ' falling: ' END, moved) AS summary,
               concat(upper(analyte), ' moved ', moved, ' (', since, ' → ', until, ') — trending the wrong way despite prior results.') AS detail, ids AS evidence, 1 AS o0, seen.d AS o1, seen.i AS o2, 0 AS o3,
               concat('Review ', upper(analyte), ' management|Consider treatment intensification or specialist referral') AS suggestions
        FROM o_judged WHERE worse""",
    "o_keyword": _table("k", "analyte, keyword", [(a, k) for a, ks in V.FOLLOWUP.items() for k in ks]),
    "o_speaks": "SELECT DISTINCT analyte, coalesce(keyword, analyte) AS keyword FROM (SELECT DISTINCT analyte FROM o_lab) LEFT JOIN o_keyword USING (analyte)",
    "o_evidence": f"""
        SELECT patient_id, valid_from, lower(concat_ws(' ', value, condition)) AS said FROM v_chart
        WHERE status <> 'retracted' AND (resource_type IN ('Procedure', 'Condition') OR lower(subject) IN {_in(V.NOTES)})""",
    "o_gap_card": f"""
        SELECT j.patient_id, concat('followup_gap:gap:', j.analyte) AS check_id, 'warning' AS indicator, concat('Abnormal ', upper(j.analyte), ' (', coalesce(printf('%g', l.reading), l.value), ') with no follow-up') AS summary,
               concat(upper(j.analyte), ' was ', coalesce(printf('%g', l.reading), l.value), ' (', lower(trim(l.abnormal_flag)), ') on ', j.latest_from, ' with no subsequent lab, note, or referral on record.') AS detail,
               CAST(l.id AS VARCHAR) AS evidence, 1 AS o0, seen.d AS o1, seen.i AS o2, 0 AS o3,
               concat('Order a repeat ', upper(j.analyte), '|Refer to the relevant specialist|Document a follow-up plan') AS suggestions
        FROM o_judged j JOIN v_chart l ON l.id = j.latest
        WHERE NOT worse AND j.analyte NOT IN {_in(V.RISK_FACTORS)} AND date_diff('day', j.latest_from, {TODAY}) >= 90 AND last_lab <= latest_from
          AND NOT EXISTS (SELECT 1 FROM o_evidence e JOIN o_speaks k ON contains(e.said, k.keyword) WHERE e.patient_id = j.patient_id AND e.valid_from > j.latest_from AND k.analyte = j.analyte)""",
    "o_allergy": f"SELECT id, patient_id, valid_from, {_SUBSTANCE} AS substance, reaction, severity FROM v_chart WHERE resource_type = 'Allergy' AND status = 'active' AND lower(trim(predicate)) <> 'cleared'",
    "o_react": """
        SELECT d.text AS drug, s.text AS substance FROM o_text d JOIN o_text s ON true LEFT JOIN o_class dc ON dc.text = d.text LEFT JOIN o_class sc ON sc.text = s.text
        WHERE dc.class = sc.class OR dc.grp = sc.grp OR EXISTS (SELECT 1 FROM o_word w WHERE w.text = d.text AND w.word = lower(trim(s.text)))""",
    "o_forbidden": f"""
        SELECT a.patient_id, r.drug, a.substance, a.id AS allergy, a.valid_from AS allergy_from, concat({_sentence("split_part(r.drug, ' ', 1)")}, coalesce(' is a ' || c.class, ''), CASE WHEN c.grp = 'beta_lactam' THEN ' (beta-lactam class)' ELSE '' END,
               '; the patient has a documented ', a.substance, ' allergy', CASE WHEN a.reaction <> '' THEN concat('; prior reaction: ', a.reaction) ELSE '' END, CASE WHEN a.severity <> '' THEN concat(' (severity: ', a.severity, ')') ELSE '' END, '.') AS detail, replace(coalesce(c.grp, c.class, 'related'), '_', ' ') AS agents
        FROM o_allergy a JOIN o_react r ON r.substance = a.substance LEFT JOIN o_class c ON c.text = r.drug""",
    "o_allergy_card": f"""
        SELECT m.patient_id, 'allergy' AS check_id, 'critical' AS indicator, concat('Active medication ', split_part(f.drug, ' ', 1), ' conflicts with ', f.substance, ' allergy') AS summary, f.detail,
               CAST(f.allergy AS VARCHAR) AS evidence, 0 AS o0, m.valid_from AS o1, m.id AS o2, f.allergy AS o3,
               concat('Avoid ', split_part(f.drug, ' ', 1), ' and other ', f.agents, ' agents|Choose a non-cross-reactive alternative|Reconfirm the allergy and reaction with the patient') AS suggestions
        FROM v_chart m JOIN o_forbidden f ON f.patient_id = m.patient_id AND f.drug = trim(coalesce(nullif(m.drug, ''), m.value)) WHERE m.resource_type = 'Medication' AND m.status = 'active'""",
    "o_order": "SELECT patient_id, drug FROM v_patient, (VALUES ('amoxicillin 500mg'), ('azithromycin'), ('zinc')) AS p(drug)",
    "o_family": f"""
        SELECT c.id, c.patient_id, c.valid_from, r.category, coalesce(age_at_onset < 55, false) AS early,
               concat({_sentence("c.relation")}, ' had ', {_FILLED_CONDITION}, CASE WHEN age_at_onset > 0 THEN concat(' at age ', age_at_onset) ELSE '' END) AS described
        FROM v_chart c JOIN o_risk r ON r.text = {_FILLED_CONDITION} WHERE resource_type = 'FamilyHistory' AND status <> 'retracted' AND lower(trim(relation)) IN {_in(V.FIRST_DEGREE)}""",
    "o_factor": """
        SELECT patient_id, id, valid_from, label FROM (SELECT *, CASE
          WHEN resource_type = 'Lifestyle' AND lower(concat(factor, ' ', value)) LIKE '%smok%' AND lower(concat(factor, ' ', value)) NOT LIKE '%non-smok%' AND lower(concat(factor, ' ', value)) NOT LIKE '%never%' THEN 'current smoker'
          WHEN resource_type = 'LabResult' AND analyte = 'ldl' AND lower(trim(abnormal_flag)) IN ('high', 'abnormal', 'critical') THEN concat('elevated LDL', CASE WHEN reading IS NULL THEN '' ELSE printf(' %g', reading) END) END AS label
          FROM v_chart WHERE status <> 'retracted') WHERE label IS NOT NULL""",
    "o_heart_card": """
        SELECT f.patient_id, 'combined_risk:cardiovascular' AS check_id, 'warning' AS indicator, 'Elevated cardiovascular risk — family history plus active risk factors' AS summary,
               concat(f.described, ', combined with ', o.labels, ', raises this patient''s cardiovascular risk.') AS detail, concat(f.id, ',', o.ids) AS evidence, 2 AS o0, DATE '0001-01-01' AS o1, 0 AS o2, 0 AS o3,
               'Assess 10-year cardiovascular risk|Discuss smoking cessation|Consider lipid-lowering therapy and cardiovascular review' AS suggestions
        FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY valid_from, id) AS place FROM o_family WHERE category = 'cardiovascular' AND early) f
        JOIN (SELECT patient_id, string_agg(label, ', ' ORDER BY valid_from, id) AS labels, string_agg(id, ',' ORDER BY valid_from, id) AS ids FROM o_factor GROUP BY patient_id) o ON o.patient_id = f.patient_id
        WHERE place = 1""",
    "o_risk_card": """
        SELECT * FROM o_heart_card UNION ALL
        SELECT patient_id, concat('combined_risk:', category), 'warning', concat('Hereditary ', category, ' risk — first-degree family history'), concat(described, ', conferring a hereditary ', category, ' risk.'),
               CAST(id AS VARCHAR), 2, valid_from, id, 0, concat('Consider ', category, ' screening per family-history guidelines') FROM o_family WHERE category <> 'cardiovascular'""",
    "o_has": f"""
        SELECT patient_id, first(category ORDER BY valid_from, id) AS category, string_agg(DISTINCT condition, ', ' ORDER BY condition) AS conditions
        FROM (SELECT c.patient_id, c.valid_from, c.id, r.category, {_FILLED_CONDITION} AS condition FROM v_chart c JOIN o_risk r ON r.text = {_FILLED_CONDITION} WHERE resource_type = 'Condition' AND status = 'active') GROUP BY patient_id""",
    "o_hereditary_card": """
        SELECT e.a AS patient_id, concat('hereditary:', category) AS check_id, 'warning' AS indicator, concat('Hereditary ', category, ' risk — from a linked relative''s record') AS summary,
               CASE WHEN confidence = 'high' THEN concat('This patient''s ', relation, ' — a linked patient (', p.name, ') — has ', conditions, ', conferring a hereditary ', category, ' risk.')
                    ELSE concat('A first-degree relative in the system has a heritable ', category, ' condition. Enable family-record consent to see details.') END AS detail, '' AS evidence,
               3 AS o0, DATE '0001-01-01' AS o1, fact_id * 2 + way AS o2, e.b AS o3, concat('Consider ', category, ' screening per family-history guidelines') AS suggestions
        FROM o_edge e JOIN o_has h ON h.patient_id = e.b JOIN v_patient p ON p.patient_id = e.b""",
    "o_card": """
        SELECT * FROM o_allergy_card UNION ALL SELECT * FROM o_trend_card UNION ALL SELECT * FROM o_gap_card UNION ALL SELECT * FROM o_risk_card UNION ALL SELECT * FROM o_hereditary_card""",
    # What is asked, cited and extracted.
    "o_asked": f"""
        SELECT id AS query_id, CASE WHEN id % 6 = 0 THEN concat('New ', id % 4) ELSE relative_name END AS name, relative_dob AS dob, CASE WHEN id % 6 <> 0 THEN lower(trim(relative_mrn)) END AS mrn,
               CASE WHEN id % 4 = 0 THEN patient_id + id % 9 * 500 END AS hint, CASE WHEN id % 16 = 8 THEN patient_id + id % 7 * 700 END AS ref FROM v_chart WHERE resource_type = 'FamilyHistory'""",
    "o_found": f"""
        SELECT q.*, {_NN.format("q.name")} AS nn, coalesce((SELECT min(p.patient_id) FROM o_person p WHERE p.mrn = q.mrn),
               (SELECT min(p.patient_id) FROM o_person p WHERE p.nn = {_NN.format("q.name")} AND (p.dob IS NULL OR q.dob IS NULL OR p.dob = q.dob))) AS found FROM o_asked q""",
    "o_new": """
        SELECT who, min(query_id) AS first, row_number() OVER (ORDER BY min(query_id)) + (SELECT max(patient_id) FROM v_patient) AS pid FROM (
          SELECT *, CASE WHEN coalesce(mrn, '') <> '' THEN concat('mrn ', mrn) ELSE concat('name ', nn, ' ', coalesce(CAST(dob AS VARCHAR), '')) END AS who FROM o_found
          WHERE found IS NULL AND (coalesce(trim(name), '') <> '' OR coalesce(mrn, '') <> '')) GROUP BY who""",
    "o_resolved": """
        SELECT f.*, n.pid FROM o_found f LEFT JOIN o_new n ON f.found IS NULL AND n.who = CASE WHEN coalesce(f.mrn, '') <> '' THEN concat('mrn ', f.mrn) ELSE concat('name ', f.nn, ' ', coalesce(CAST(f.dob AS VARCHAR), '')) END""",
    "o_cited": """
        SELECT patient_id AS answer_id, id * 3 AS id, row_number() OVER (PARTITION BY patient_id ORDER BY id) - 1 AS place FROM v_chart WHERE patient_id % 5 <> 0""",
    "o_answer": """
        SELECT a.patient_id AS answer_id, coalesce(c.n, 0) AS grounded, CASE WHEN c.disputed THEN 'contested' WHEN a.patient_id % 4 <> 0 AND c.unsure THEN 'low_confidence'
               WHEN a.patient_id % 4 = 0 THEN 'low_confidence' ELSE 'settled' END AS certainty
        FROM (SELECT DISTINCT patient_id FROM v_chart) a LEFT JOIN (
          SELECT answer_id, count(*) AS n, bool_or(status = 'contested') AS disputed, bool_or(status = 'active' AND confidence < 0.6) AS unsure FROM o_cited c JOIN v_chart f ON f.id = c.id GROUP BY answer_id) c ON c.answer_id = a.patient_id""",
    "o_raw_row": f"""
        SELECT c.*, source_document AS doc_id, CASE WHEN id % 41 = 0 THEN 'rumour' WHEN id % 43 = 0 THEN '' ELSE coalesce(lower(resource_type), '') END AS kind, CASE WHEN id % 37 = 0 THEN '' ELSE value END AS said,
               CASE WHEN id % 3 = 0 THEN substr(CAST(valid_from AS VARCHAR), 1, 7) END AS given, lower(trim(predicate)) IN ('cleared', 'resolved') AS cleared, CASE WHEN id % 9 <> 0 AND reading <> 0 THEN reading END AS number,
               CASE WHEN id % 4 <> 0 THEN age_at_onset END AS age FROM v_chart c""",
    "o_filled": """
        SELECT *, coalesce(nullif(substance, ''), said) AS f_substance, coalesce(nullif(drug, ''), said) AS f_drug, coalesce(nullif(condition, ''), said) AS f_condition, coalesce(upper(nullif(analyte, '')), said) AS f_analyte,
               coalesce(nullif(factor, ''), said) AS f_factor FROM o_raw_row""",
    "o_made": f"""
        SELECT id, doc_id, coalesce(given, '1997-01-01') AS date, given,
               CASE kind WHEN 'allergy' THEN 'Allergy' WHEN 'medication' THEN 'Medication' WHEN 'condition' THEN 'Condition' WHEN 'labresult' THEN 'LabResult' WHEN 'familyhistory' THEN 'FamilyHistory'
                    WHEN 'lifestyle' THEN 'Lifestyle' WHEN 'vital' THEN ' vital' WHEN 'procedure' THEN ' procedure' END AS resource_type,
               CASE kind WHEN 'allergy' THEN 'allergy' WHEN 'medication' THEN 'medication' WHEN 'condition' THEN 'diagnosis' WHEN 'labresult' THEN concat('lab ', lower(f_analyte)) WHEN 'familyhistory' THEN 'family'
                    WHEN 'lifestyle' THEN 'lifestyle' WHEN 'vital' THEN 'vital' WHEN 'procedure' THEN 'procedure' ELSE 'note' END AS subject,
               CASE kind WHEN 'allergy' THEN CASE WHEN cleared THEN 'cleared' ELSE 'diagnosed' END WHEN 'medication' THEN 'prescribed' WHEN 'condition' THEN CASE WHEN cleared THEN 'resolved' ELSE 'diagnosed' END
                    WHEN 'labresult' THEN 'measured' WHEN 'familyhistory' THEN 'reported' WHEN 'lifestyle' THEN 'reported' WHEN 'vital' THEN 'measured' WHEN 'procedure' THEN 'performed' ELSE 'recorded' END AS predicate,
               CASE kind WHEN 'allergy' THEN trim(f_substance) WHEN 'medication' THEN trim(f_drug) WHEN 'condition' THEN trim(f_condition)
                    WHEN 'labresult' THEN trim(concat_ws(' ', trim(f_analyte), nullif(coalesce(printf('%g', number), said), ''), CASE WHEN id % 2 = 0 THEN 'mg/dL' END))
                    WHEN 'familyhistory' THEN concat({_sentence("trim(relation)")}, ': ', trim(f_condition), CASE WHEN age > 0 THEN concat(' (age ', age, ')') ELSE '' END)
                    WHEN 'lifestyle' THEN coalesce(nullif(trim(said), ''), trim(f_factor)) ELSE said END AS value,
               CASE WHEN kind = 'labresult' THEN lower(f_analyte) END AS analyte, CASE WHEN kind = 'labresult' THEN number END AS reading, CASE WHEN kind = 'labresult' AND id % 2 = 0 THEN 'mg/dL' END AS unit,
               CASE WHEN kind = 'labresult' THEN nullif(lower(trim(abnormal_flag)), '') END AS abnormal_flag, CASE WHEN kind = 'medication' THEN lower(trim(f_drug)) END AS drug,
               CASE WHEN kind = 'allergy' THEN lower(trim(f_substance)) END AS substance, CASE WHEN kind = 'allergy' THEN nullif(trim(reaction), '') END AS reaction, CASE WHEN kind = 'allergy' THEN nullif(lower(trim(severity)), '') END AS severity,
               CASE WHEN kind IN ('condition', 'familyhistory') THEN lower(trim(f_condition)) END AS condition, CASE WHEN kind = 'familyhistory' THEN lower(trim(relation)) END AS relation,
               CASE WHEN kind = 'familyhistory' THEN age END AS age_at_onset, CASE WHEN kind = 'familyhistory' THEN nullif(trim(relative_name), '') END AS relative_name,
               CASE WHEN kind = 'familyhistory' THEN CAST(relative_dob AS VARCHAR) END AS relative_dob, CASE WHEN kind = 'familyhistory' THEN nullif(trim(relative_mrn), '') END AS relative_mrn,
               CASE WHEN kind = 'lifestyle' THEN lower(trim(f_factor)) END AS factor, CASE WHEN kind = 'lifestyle' THEN trim(said) END AS factor_value
        FROM o_filled WHERE CASE kind WHEN 'allergy' THEN f_substance <> '' WHEN 'medication' THEN f_drug <> '' WHEN 'condition' THEN f_condition <> '' WHEN 'labresult' THEN f_analyte <> ''
                                      WHEN 'familyhistory' THEN coalesce(relation, '') <> '' AND f_condition <> '' WHEN 'lifestyle' THEN f_factor <> '' ELSE said <> '' END""",
    "o_misspelt": r"""
        SELECT id, CAST(list_filter(w, lambda x, i: list_position(w, x) = i) AS VARCHAR[]) AS cands FROM (
          SELECT id, list_concat(whole, flatten(list_transform(whole, lambda x: list_filter(regexp_split_to_array(replace(x, '/', ' '), '\s+'), lambda t: t <> '')))) AS w FROM (
            SELECT id, list_filter([trim(coalesce(CASE WHEN resource_type IN ('Medication', 'Allergy') THEN coalesce(nullif(drug, ''), nullif(substance, '')) WHEN resource_type = 'LabResult' THEN analyte
                     WHEN resource_type IN ('Condition', 'FamilyHistory') THEN condition END, '')), trim(value)], lambda x: x <> '') AS whole FROM v_misspelt))""",
    "o_document": """
        SELECT CAST(floor(id / 5) AS BIGINT) AS doc_id, max(patient_id) AS patient_id, min(valid_from) AS doc_date FROM v_chart GROUP BY 1""",
    "o_call": """
        SELECT conv_id * 100 + CAST(floor(turn / 3) AS BIGINT) AS turn_id, turn AS seq, conv_id, CASE WHEN turn % 4 <> 1 THEN concat('call ', turn) ELSE '' END AS chip, CASE WHEN turn % 2 = 0 THEN conv_id + turn END AS fact_id,
               CASE WHEN turn % 5 = 1 THEN 1 WHEN turn % 7 = 2 THEN 2 ELSE 0 END AS rank, CASE WHEN turn % 3 = 2 THEN conv_id END AS pending FROM conversations""",
}

_SHOWN = "patient_id, check_id, indicator, summary, detail, evidence"
_LABEL = f"""CASE WHEN lower(subject) = 'allergy' AND lower(predicate) = 'cleared' THEN concat({_sentence("value")}, ' allergy cleared') WHEN lower(subject) = 'allergy' THEN concat('Allergic to ', value)
    WHEN lower(subject) = 'medication' AND lower(predicate) = 'switched' THEN concat('Switched to ', value) WHEN lower(subject) = 'medication' THEN concat('On ', value)
    WHEN lower(subject) = 'diagnosis' THEN concat('Diagnosed: ', value) ELSE concat(upper(predicate[1]), lower(predicate[2:]), ' ', value) END"""
_TREND = f"""
    SELECT patient_id, subject, count(*) AS n, string_agg(printf('%g', reading), ' → ' ORDER BY valid_from, id) AS seq, first(reading ORDER BY valid_from, id) AS a, last(reading ORDER BY valid_from, id) AS z,
           min(valid_from) AS since, max(valid_from) AS until, upper(substr(subject, 5)) AS name, substr(subject, 5) IN {_in(V.RISING_BAD)} AS up_is_bad
    FROM v_chart WHERE status = 'active' AND reading IS NOT NULL GROUP BY patient_id, subject"""


def _raw(column: str, of: str, name: str) -> str:
    return f"SELECT id, {of} AS {name} FROM (SELECT id, {column} AS raw FROM v_raw)"


_PARTS = _values([(i, p, a) for i, (p, a) in enumerate(V.ANALYTE_PARTS.items())])

QUERIES = {
    "snapshot_as_of": f"SELECT id, patient_id, subject, CAST(value AS VARCHAR) AS value, valid_from, valid_to, status FROM o_ledger WHERE valid_from <= {AS_OF} AND (valid_to IS NULL OR valid_to > {AS_OF})",
    "snapshots_asked": """
        SELECT d.patient_id, d.day, l.id, l.subject, CAST(l.value AS VARCHAR) AS value, l.status FROM (SELECT DISTINCT patient_id, CAST(valid_from + 5 AS DATE) AS day FROM v_state) d
        JOIN o_ledger l ON l.patient_id = d.patient_id AND l.valid_from <= d.day AND (l.valid_to IS NULL OR l.valid_to > d.day)""",
    "ledger_active": "SELECT id, patient_id, subject, CAST(value AS VARCHAR) AS value, valid_from FROM o_ledger WHERE status = 'active'",
    "ledger_history": "SELECT patient_id, subject, id, CAST(value AS VARCHAR) AS value, valid_from, valid_to, status, superseded_by FROM o_ledger",
    "supersession_chain": "SELECT start, step, id FROM o_chain",
    "supersession_rank": "SELECT id, chain, position, length FROM o_rank",
    "reconcile_islands": "SELECT id, patient_id, subject, CAST(value AS VARCHAR) AS value, valid_from, valid_to, superseded_by, status, percent AS confidence_percent FROM o_ledger",
    "reconcile_contested": "SELECT id, patient_id, subject, CAST(value AS VARCHAR) AS value, valid_from, percent / 100 AS confidence FROM o_ledger WHERE status = 'contested'",
    "reconcile_classified": "SELECT id, patient_id, subject, cls AS classification, target FROM o_verdict",
    "status_three_valued": f"SELECT id, CASE WHEN valid_from > {AS_OF} THEN 'future' WHEN valid_to <= {AS_OF} THEN 'replaced' ELSE 'active' END AS status FROM o_ledger",
    "retract_restore": """
        SELECT l.id, l.patient_id, l.subject, CAST(l.value AS VARCHAR) AS value, l.valid_from, CASE WHEN r.id IS NULL THEN l.valid_to END AS valid_to, CASE WHEN r.id IS NULL THEN l.superseded_by END AS superseded_by,
               CASE WHEN l.id % 10 = 0 THEN 'retracted' WHEN r.id IS NOT NULL THEN 'active' ELSE l.status END AS status,
               CASE WHEN l.id % 10 = 0 THEN 'entered in error' WHEN r.id IS NOT NULL THEN 'restored: superseding fact retracted (entered in error)' ELSE l.reason END AS reason
        FROM o_ledger l LEFT JOIN (SELECT first(id ORDER BY valid_from, id) AS id FROM o_ledger WHERE superseded_by % 10 = 0 GROUP BY superseded_by) r ON r.id = l.id""",
    "forget_approved": """
        SELECT CASE WHEN g THEN 'retracted' WHEN back THEN 'active' ELSE status END AS status, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, count(CASE WHEN NOT back THEN valid_to END) AS closed
        FROM (SELECT *, id % 25 = 0 AS g, coalesce(superseded_by % 25 = 0, false) AS back FROM o_ledger) GROUP BY 1""",
    "ledger_upsert": """
        SELECT id, patient_id, subject, bucket + CASE WHEN id % 4 = 0 THEN 100 ELSE 0 END AS value, valid_from FROM v_state UNION ALL SELECT -id, patient_id, subject, bucket, valid_from FROM v_state WHERE id % 50 = 1""",
    "fact_lookup": "SELECT a.id * 2 AS id, f.subject, f.status FROM v_chart a LEFT JOIN v_chart f ON f.id = a.id * 2",
    "why_trend": f"SELECT patient_id, subject, n, seq, CASE WHEN n < 2 THEN 'single reading' WHEN a = z THEN 'steady' WHEN z > a THEN 'rising' ELSE 'falling' END AS trend, CASE WHEN n > 1 AND a <> z THEN (z > a) = up_is_bad END AS wrong_way FROM ({_TREND})",
    "trend_reasons": f"""
        SELECT patient_id, subject, CASE WHEN n < 2 THEN concat(name, ' has no other dated readings on record to compare against.')
               WHEN a = z THEN concat(name, ' has stayed steady at ', printf('%g', z), ' across ', n, ' readings (', since, ' → ', until, ').')
               ELSE concat(name, CASE WHEN z > a THEN ' is rising: ' ELSE ' is falling: ' END, seq, ' (', since, ' → ', until, ') — ', CASE WHEN (z > a) = up_is_bad THEN 'trending the wrong way despite prior results.' ELSE 'trending in the right direction.' END) END AS reason
        FROM ({_TREND})""",
    "why_facts": """
        SELECT l.id, s.id AS replaced_by, coalesce(l.reason, s.reason, '') AS reason, coalesce(s.source, l.source) AS source, coalesce(s.valid_from, l.valid_from) AS date,
               CASE WHEN s.id IS NULL AND k.n > 1 THEN k.n ELSE 0 END AS siblings
        FROM o_ledger l LEFT JOIN o_ledger s ON s.id = l.superseded_by LEFT JOIN (SELECT patient_id, subject, count(*) AS n FROM o_ledger WHERE status = 'active' GROUP BY 1, 2) k ON k.patient_id = l.patient_id AND k.subject = l.subject""",
    "why_answers": """
        SELECT l.id, s.id AS replaced_by, coalesce(l.reason, s.reason, '') AS reason, coalesce(s.source, l.source) AS source, coalesce(s.valid_from, l.valid_from) AS date,
               CASE WHEN s.id IS NULL AND k.n > 1 THEN k.n ELSE 0 END AS siblings, r.chain, r.position, r.length, CASE WHEN s.id IS NULL AND k.n > 1 THEN k.way END AS trend,
               CASE WHEN s.id IS NULL AND k.n > 1 THEN CASE WHEN k.way = 'steady' THEN concat(upper(l.subject), ' has stayed steady at ', k.z, ' across ', k.n, ' readings (', k.since, ' → ', k.until, ').')
                 ELSE concat(upper(l.subject), ' is ', k.way, ': ', k.seq, ' (', k.since, ' → ', k.until, ') — ', CASE WHEN k.way = 'falling' THEN 'trending the wrong way despite prior results.' ELSE 'trending in the right direction.' END) END END AS trend_reason
        FROM o_ledger l LEFT JOIN o_ledger s ON s.id = l.superseded_by JOIN o_rank r ON r.id = l.id LEFT JOIN (
          SELECT *, CASE WHEN a = z THEN 'steady' WHEN z > a THEN 'rising' ELSE 'falling' END AS way FROM (
            SELECT patient_id, subject, count(*) AS n, string_agg(value, ' → ' ORDER BY valid_from, id) AS seq, first(value ORDER BY valid_from, id) AS a, last(value ORDER BY valid_from, id) AS z, min(valid_from) AS since, max(valid_from) AS until
            FROM o_ledger WHERE status = 'active' GROUP BY 1, 2)) k ON k.patient_id = l.patient_id AND k.subject = l.subject""",
    "why_narratives": """
        SELECT patient_id, subject, CASE WHEN replaced IS NOT NULL THEN concat('Change history:', chr(10), lines, coalesce(chr(10) || chr(10) || 'Current state: ' || now, ''))
               WHEN k > 1 THEN concat('No single record replaced another — ', subject, ' has ', k, ' readings on file, each still active: ', points, '.') WHEN k = 1 THEN concat('Current: ', now, ' No prior changes recorded.')
               ELSE 'No relevant changes found in the records.' END AS narrative, coalesce(replaced, now_id) AS fact_id
        FROM (SELECT l.patient_id, l.subject, first(l.id ORDER BY l.valid_from, l.id) FILTER (WHERE s.id IS NOT NULL) AS replaced, count(*) FILTER (WHERE l.status = 'active') AS k,
                     string_agg(concat('• ', l.label, ' (', l.valid_from, ', ', l.source, ') was replaced by ', s.label, ' (', s.valid_from, ', ', s.source, ')', CASE WHEN s.reason <> '' THEN concat(' — reason: ', s.reason) ELSE '' END), chr(10) ORDER BY l.valid_from, l.id) FILTER (WHERE s.id IS NOT NULL) AS lines,
                     string_agg(concat(l.label, ' (', l.valid_from, ')'), '; ' ORDER BY l.valid_from, l.id) FILTER (WHERE l.status = 'active') AS points,
                     last(concat(l.label, ' (since ', l.valid_from, ', source: ', l.source, ').') ORDER BY l.valid_from, l.id) FILTER (WHERE l.status = 'active') AS now, last(l.id ORDER BY l.valid_from, l.id) FILTER (WHERE l.status = 'active') AS now_id
              FROM o_ledger l LEFT JOIN o_ledger s ON s.id = l.superseded_by GROUP BY 1, 2)""",
    "graph_nodes": f"""
        SELECT patient_id, concat('fact:', id) AS node, 'fact' AS kind, 'Other' AS category, label, CASE WHEN valid_from <= {AS_OF} AND coalesce(valid_to > {AS_OF}, true) THEN 'active' ELSE 'superseded' END AS status FROM o_ledger
        UNION ALL SELECT a, concat('rel:', b), 'relative', 'Family', concat({_sentence("relation")}, ' · ', p.name), 'active' FROM o_edge JOIN v_patient p ON p.patient_id = b WHERE confidence = 'high' AND a IN (SELECT patient_id FROM o_ledger)""",
    "graph_edges": """
        SELECT concat('fact:', id) AS source, concat('fact:', superseded_by) AS target, 'SUPERSEDED_BY' AS kind, NULL AS label FROM o_ledger WHERE superseded_by IS NOT NULL
        UNION ALL SELECT concat('fact:', id), concat('fact:', next), 'SAME_SUBJECT', NULL FROM (SELECT *, lead(id) OVER (PARTITION BY patient_id, subject ORDER BY valid_from, id) AS next FROM o_ledger) WHERE next <> coalesce(superseded_by, -1)
        UNION ALL SELECT concat('fact:', anchor), concat('rel:', b), 'RELATED_TO', relation FROM o_edge JOIN (SELECT patient_id, first(id ORDER BY valid_from, id) AS anchor FROM o_ledger GROUP BY 1) ON patient_id = a WHERE confidence = 'high'""",
    "graph_edges_superseded": "SELECT id AS source, superseded_by AS target, 'SUPERSEDED_BY' AS kind FROM o_ledger WHERE superseded_by IS NOT NULL",
    "followup_gap_open": f"SELECT patient_id, summary, {TODAY} AS as_of FROM o_gap_card",
    "batch_dedup_split": """
        SELECT d.doc_id, EXISTS (SELECT 1 FROM documents e WHERE coalesce(e.text, '') = coalesce(d.text, '') AND floor(e.doc_id / 100) < floor(d.doc_id / 100)) AS duplicate FROM documents d""",
    "lab_trend_cards": f"SELECT {_SHOWN} FROM o_trend_card",
    "followup_gap": f"SELECT {_SHOWN} FROM o_gap_card",
    "allergy_conflict": f"SELECT {_SHOWN}, o2 AS ord2 FROM o_allergy_card",
    "prescribe_screen": "SELECT o.patient_id, o.drug, CASE WHEN count(f.allergy) > 0 THEN 'critical' ELSE 'clear' END AS verdict, count(f.allergy) AS cards FROM o_order o LEFT JOIN o_forbidden f ON f.patient_id = o.patient_id AND f.drug = o.drug GROUP BY 1, 2",
    "prescribe_cards": "SELECT o.patient_id, o.drug, 'allergy' AS check_id, 'critical' AS indicator, concat('Do not prescribe ', split_part(o.drug, ' ', 1), ' — ', substance, ' allergy') AS summary, detail, CAST(allergy AS VARCHAR) AS evidence FROM o_order o JOIN o_forbidden f ON f.patient_id = o.patient_id AND f.drug = o.drug",
    "prescribe_top": """
        SELECT * FROM (SELECT o.patient_id, o.drug, row_number() OVER (PARTITION BY o.patient_id, o.drug ORDER BY allergy_from, allergy) AS place, 'allergy' AS check_id, 'critical' AS indicator,
          concat('Do not prescribe ', split_part(o.drug, ' ', 1), ' — ', substance, ' allergy') AS summary, detail, CAST(allergy AS VARCHAR) AS evidence FROM o_order o JOIN o_forbidden f ON f.patient_id = o.patient_id AND f.drug = o.drug) WHERE place <= 5""",
    "order_texts": """
        SELECT o.patient_id, o.drug, coalesce('Prescribe-time safety findings (nothing has been ordered):' || chr(10) || string_agg(concat('- [CRITICAL] Do not prescribe ', split_part(o.drug, ' ', 1), ' — ', substance, ' allergy: ', detail), chr(10) ORDER BY nth) FILTER (WHERE f.allergy IS NOT NULL),
               concat('No allergy or contraindication found for ', o.drug, ' in this patient''s records. This is a safety screen only — confirm dosing and interactions for your review.')) AS text
        FROM o_order o LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY patient_id, drug ORDER BY allergy_from, allergy) AS nth FROM o_forbidden) f ON f.patient_id = o.patient_id AND f.drug = o.drug AND nth <= 5 GROUP BY 1, 2""",
    "combined_cv_risk": f"SELECT {_SHOWN} FROM o_heart_card",
    "combined_risk": f"SELECT {_SHOWN} FROM o_risk_card",
    "own_factors": "SELECT patient_id, id, label FROM o_factor",
    "hereditary_cards": f"SELECT {_SHOWN}, o3 AS ord3 FROM o_hereditary_card",
    "cards_top5": "SELECT patient_id, place, check_id, indicator, summary FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY indicator <> 'critical', o0, o1, o2, o3) AS place FROM o_card) WHERE place <= 5",
    "critical_dashboard": "SELECT patient_id, count(*) AS cards, count(*) FILTER (WHERE indicator = 'critical') AS critical, count(*) FILTER (WHERE indicator = 'warning') AS warnings, CASE WHEN bool_or(indicator = 'critical') THEN 0 ELSE 1 END AS worst FROM o_card GROUP BY patient_id",
    "checks_focus": """
        SELECT patient_id, count(*) AS cards, min(check_id) AS first FROM (
          SELECT *, bool_or(hit) OVER (PARTITION BY patient_id) AS any_hit FROM (SELECT *, contains(lower(concat(summary, detail)), CASE WHEN patient_id % 2 = 0 THEN 'ldl' ELSE 'allergy' END) AS hit FROM o_card)) WHERE hit OR NOT any_hit GROUP BY patient_id""",
    "card_suggestions": "SELECT patient_id, check_id, summary, evidence, suggestions FROM o_card",
    "cards_text": "SELECT patient_id, string_agg(concat('- [WARNING] ', summary, ': ', detail), chr(10) ORDER BY o1, o2) AS text FROM o_risk_card GROUP BY patient_id",
    "risk_assertions": "SELECT patient_id, concat('Risk synthesis for patient ', patient_id, ': ', summary, '. ', detail) AS text FROM o_risk_card",
    "brief_sections": f"""
        SELECT p.patient_id, 1998 - year(dob) - CASE WHEN month(dob) * 100 + day(dob) > 630 THEN 1 ELSE 0 END AS age, count(c.id) AS facts,
               {", ".join(f"count(CASE WHEN c.resource_type = '{k}' THEN 1 END) AS {n}" for k, n in V.SECTIONS.items())},
               string_agg(DISTINCT CASE WHEN c.resource_type = 'Allergy' AND c.status = 'active' AND lower(trim(c.predicate)) <> 'cleared' THEN coalesce(nullif(substance, ''), value) END, ', '
                          ORDER BY CASE WHEN c.resource_type = 'Allergy' AND c.status = 'active' AND lower(trim(c.predicate)) <> 'cleared' THEN coalesce(nullif(substance, ''), value) END) AS badge,
               p.patient_id IN (SELECT patient_id FROM o_card) AS risk
        FROM v_patient p LEFT JOIN v_chart c ON c.patient_id = p.patient_id AND c.status <> 'retracted' GROUP BY p.patient_id, dob""",
    "brief_rows": f"""
        SELECT patient_id, section, row_number() OVER (PARTITION BY patient_id, section ORDER BY valid_from, id) AS place, id, {_LABEL} AS label, value, valid_from, status
        FROM v_chart JOIN (VALUES {_values(list(V.SECTIONS.items()))}) AS k(rt, section) ON rt = resource_type WHERE status <> 'retracted'""",
    "birth_years": "SELECT id, TRY_CAST(CASE WHEN raw_date[:4] SIMILAR TO '[0-9]{4}' THEN raw_date[:4] END AS INT) AS year FROM v_raw",
    "timeline_files": """
        SELECT id, concat('patient_timeline_', CASE WHEN n < 10 THEN '0' ELSE '' END, n, '.json') AS file FROM (SELECT id, CAST(regexp_replace(concat(id % 150, substr(raw_flag, 1, 1)), '[^0-9]', '', 'g') AS BIGINT) AS n FROM v_raw)""",
    "patient_resolve": """
        SELECT q.doctor_id, q.query, count(p.patient_id) AS candidates, CASE WHEN count(p.patient_id) = 1 THEN min(p.patient_id) END AS resolved
        FROM (SELECT DISTINCT doctor_id, query FROM v_access, (VALUES ('mrn-900007'), ('given-3 '), (' O''Fam12'), ('42'), ('nobody')) AS q(query)) q
        LEFT JOIN (SELECT doctor_id, v_patient.* FROM v_access JOIN v_patient USING (patient_id)) p
          ON p.doctor_id = q.doctor_id AND (contains(lower(p.name), lower(trim(q.query))) OR contains(lower(p.mrn), lower(trim(q.query))) OR CAST(p.patient_id AS VARCHAR) = trim(q.query)) GROUP BY 1, 2""",
    "entity_find": "SELECT query_id, found FROM o_found",
    "entity_resolve": "SELECT query_id, coalesce(found, pid) AS patient, pid IS NOT NULL AS created FROM o_resolved",
    "new_patients": """
        SELECT n.pid AS patient_id, coalesce(nullif(trim(f.name), ''), concat('P', lpad(CAST(n.pid AS VARCHAR), CAST(greatest(3, length(CAST(n.pid AS VARCHAR))) AS INT), '0'))) AS name, f.dob,
               coalesce((SELECT nullif(trim(relative_mrn), '') FROM v_chart c WHERE c.id = n.first AND c.id % 6 <> 0), concat('MRN-', n.pid + 900000)) AS mrn FROM o_new n JOIN o_found f ON f.query_id = n.first""",
    "chart_of_document": """
        SELECT query_id, coalesce(h.patient_id, r.patient_id, found, pid, ref) AS chart, h.patient_id IS NULL AND r.patient_id IS NULL AND pid IS NOT NULL AS created
        FROM o_resolved q LEFT JOIN v_patient h ON h.patient_id = hint LEFT JOIN v_patient r ON r.patient_id = ref""",
    "kinship_match": "SELECT fact_id, patient_id, relation, rid AS relative_id, confidence FROM o_kin",
    "kinship_links_reciprocal": "SELECT a AS patient_id, b AS relative_id, relation, confidence, confidence = 'high' AS consent, confidence <> 'high' AS proposed FROM o_edge",
    "consented_links": "SELECT a AS patient_id, b AS relative_id, relation FROM o_edge WHERE confidence = 'high'",
    "consent_update": """
        SELECT a AS patient_id, b AS relative_id, CASE WHEN least(a, b) % 2 = 0 THEN greatest(a, b) % 3 = 0 ELSE confidence = 'high' END AS consent, confidence <> 'high' AS proposed FROM o_edge""",
    "family_members": """
        SELECT f.a AS patient_id, p.name, p.mrn, CASE WHEN f.relation = 'child' THEN r.mrn END AS parent_mrn
        FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY fact_id * 2 + way) AS nth FROM o_edge) f JOIN v_patient p ON p.patient_id = f.a JOIN v_patient r ON r.patient_id = f.b WHERE nth = 1""",
    "doctors": "SELECT doctor_id, doctor FROM v_doctor",
    "canonical_analyte": _raw("raw_name", rf"coalesce((SELECT arg_min(a, o) FROM (VALUES {_PARTS}) AS p(o, part, a) WHERE contains(lower(trim(raw)), part)), regexp_extract(lower(trim(raw)), '^\S*'))", "analyte"),
    "canonical_flag": _raw("raw_flag", "CASE WHEN lower(trim(raw)) = 'h' THEN 'high' WHEN lower(trim(raw)) = 'l' THEN 'low' ELSE lower(trim(raw)) END", "canonical"),
    "coerce_date": _raw("raw_date", f"""
        coalesce(TRY_CAST(CASE WHEN regexp_matches(trim(raw), '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN trim(raw)[:10] WHEN regexp_matches(trim(raw), '^\\d{{4}}-\\d{{2}}$') THEN trim(raw) || '-01' WHEN regexp_matches(trim(raw), '^\\d{{4}}$') THEN trim(raw) || '-01-01' END AS DATE),
                 CASE WHEN length(raw) % 2 = 0 THEN DATE '2003-04-05' ELSE {TODAY} END)""", "coerced"),
    "to_float": _raw("raw_number", "CASE WHEN regexp_matches(trim(raw), '^[0-9.]+(e[0-9]+)?$') THEN TRY_CAST(trim(raw) AS DOUBLE) END", "number"),
    "drug_class": "SELECT id, class, grp FROM v_chart LEFT JOIN o_class ON text = value WHERE resource_type IN ('Medication', 'Allergy')",
    "family_risk": "SELECT id, category, early, described FROM o_family",
    "ground_facts": rf"""
        SELECT id, CASE WHEN len(cands) > 0 THEN EXISTS (SELECT 1 FROM (SELECT unnest(cands) AS c) WHERE lower(trim(c)) IN (SELECT drug FROM d_drug) OR lower(trim(c)) IN (SELECT cond FROM d_condition)
                 OR lower(trim(c)) IN {_in(sorted({*V.MONITORING, *_ANALYTES_WATCHED}))}) END AS grounded, array_to_string(cands, '|') AS candidates
        FROM (SELECT id, CAST(list_filter(w, lambda x, i: list_position(w, x) = i) AS VARCHAR[]) AS cands FROM (
          SELECT id, list_concat(whole, flatten(list_transform(whole, lambda x: list_filter(regexp_split_to_array(replace(x, '/', ' '), '\s+'), lambda t: t <> '')))) AS w FROM (
            SELECT id, list_filter([trim(coalesce(CASE WHEN resource_type IN ('Medication', 'Allergy') THEN coalesce(nullif(drug, ''), nullif(substance, '')) WHEN resource_type = 'LabResult' THEN analyte
                     WHEN resource_type IN ('Condition', 'FamilyHistory') THEN condition END, '')), trim(value)], lambda x: x <> '') AS whole FROM v_chart)))""",
    "ground_facts_near": f"""
        SELECT id, CASE WHEN len(cands) > 0 THEN name IS NOT NULL END AS grounded, name, distance FROM o_misspelt LEFT JOIN (
          SELECT id, first(name ORDER BY distance, place, name) AS name, min(distance) AS distance FROM (
            SELECT id, unnest(cands) AS cand, generate_subscripts(cands, 1) AS place FROM o_misspelt) JOIN (
            SELECT c, name, levenshtein(c, name) AS distance FROM (SELECT DISTINCT lower(trim(unnest(cands))) AS c FROM o_misspelt) JOIN (
              SELECT drug AS name FROM d_drug UNION SELECT cond FROM d_condition UNION SELECT term FROM v_term WHERE class <> 'no known class'
              UNION SELECT unnest({sorted({*V.MONITORING, *_ANALYTES_WATCHED})})) ON levenshtein(c, name) <= floor(greatest(length(c), length(name)) / 5)) m ON m.c = lower(trim(cand)) GROUP BY id) USING (id)""",
    "classified_on_the_day": f"""
        SELECT * FROM (WITH vocab AS (SELECT 'drug' AS kind, drug AS term, class FROM d_drug UNION ALL SELECT 'condition', cond, category FROM d_condition),
        good AS (SELECT l.*, lower(trim(term)) AS t FROM v_learned l WHERE class IN (SELECT v.class FROM vocab v WHERE v.kind = l.kind)),
        fact AS (SELECT id, kind, lower(trim(name)) AS n, day FROM v_named),
        cand AS (
          SELECT id, kind, day, -1000000 AS place, n AS term FROM fact
          UNION ALL SELECT id, kind, day, generate_subscripts(w, 1), unnest(w) FROM (SELECT *, regexp_split_to_array(replace(n, '/', ' '), '\\s+') AS w FROM fact WHERE kind = 'drug')
          UNION ALL SELECT DISTINCT f.id, f.kind, f.day, -length(k.term), k.term FROM fact f JOIN (SELECT term FROM vocab WHERE kind = 'condition' UNION SELECT t FROM good WHERE kind = 'condition') k ON contains(f.n, k.term) WHERE f.kind = 'condition'),
        seen AS (SELECT c.id, c.place, c.term, v.class AS known, (SELECT last(g.class ORDER BY g.day, g.seq) FROM good g WHERE g.kind = c.kind AND g.t = c.term AND g.day <= c.day) AS said
                 FROM cand c LEFT JOIN vocab v ON v.kind = c.kind AND v.term = c.term)
        SELECT f.id, s.class, coalesce(s.was_learned, false) AS was_learned FROM fact f LEFT JOIN (
          SELECT id, coalesce(said, known) AS class, said IS NOT NULL AS was_learned, row_number() OVER (PARTITION BY id ORDER BY place, known IS NULL, term) AS nth FROM seen WHERE coalesce(said, known) IS NOT NULL) s ON s.id = f.id AND nth = 1)""",
    "monitoring_rules": f"SELECT id, m.analyte, every_months FROM v_chart JOIN ({_table('m', 'cond, analyte, every_months', [(c, a, m) for c, rules in V.MONITORING.items() for a, m in rules])}) AS m ON cond = lower(trim(value)) WHERE resource_type = 'Condition'",
    "ontology_triples": f"""
        SELECT t.*, (SELECT count(*) FROM v_chart WHERE lower(trim(value)) = t.s) AS facts FROM (
        SELECT drug AS s, 'type' AS p, 'Drug' AS o FROM d_drug UNION ALL SELECT DISTINCT class, 'type', 'DrugClass' FROM d_drug
        UNION ALL SELECT * FROM (SELECT cond, 'type', 'Condition' FROM d_condition UNION SELECT cond, 'type', 'Condition' FROM (VALUES {_values([(c,) for c in V.MONITORING])}) AS m(cond))
        UNION ALL SELECT drug, 'subClassOf', class FROM d_drug UNION ALL SELECT class, 'subClassOf', grp FROM d_group UNION ALL SELECT cond, 'confersFamilialRisk', category FROM d_condition
        UNION ALL SELECT cond, 'monitoredBy', analyte FROM (VALUES {_values([(c, a) for c, rules in V.MONITORING.items() for a, _ in rules])}) AS m(cond, analyte)) t(s, p, o)""",
    "fact_label": f"SELECT id, {_LABEL} AS label FROM v_chart",
    "fact_types": f"SELECT subject, type, count(*) AS n FROM v_chart LEFT JOIN (VALUES {_values(list(V.RESOURCE_TYPES.items()))}) AS t(s, type) ON s = lower(subject) GROUP BY 1, 2",
    "partition_names": "SELECT DISTINCT patient_id, concat('tr_p', patient_id) AS name_own, concat('naive_p', patient_id) AS name_naive, concat('chat_p', patient_id) AS name_chat FROM v_chart",
    "citation_join": "SELECT answer_id, place, c.id, source_document, page, valid_from FROM o_cited c JOIN v_chart f ON f.id = c.id",
    "citation_labels": "SELECT id, coalesce(nullif(document_title, ''), CAST(source_document AS VARCHAR), source) AS label FROM v_chart",
    "certainty_guard": "SELECT answer_id, certainty, grounded FROM o_answer",
    "answer_validated": """
        SELECT answer_id, CASE WHEN grounded = 0 AND certainty = 'settled' THEN 'low_confidence' ELSE certainty END AS certainty, grounded, certainty = 'contested' AS conflicting, grounded = 0 AND certainty = 'settled' AS hedged FROM o_answer""",
    "answer_fallback": f"""
        SELECT p.patient_id, CASE WHEN count(c.id) = 0 THEN 'No records have been ingested for this patient yet.' WHEN count(c.id) FILTER (WHERE status <> 'retracted') = 0 THEN 'No active clinical records found for this patient.'
               ELSE coalesce(string_agg(concat({_LABEL}, ' (since ', valid_from, ', source: ', source, ')'), '; ' ORDER BY valid_from, id) FILTER (WHERE status = 'active'), 'Could not synthesize answer') END AS text,
               'low_confidence' AS certainty, count(c.id) FILTER (WHERE status = 'active') AS grounded
        FROM v_patient p LEFT JOIN v_chart c ON c.patient_id = p.patient_id AND c.patient_id % 9 <> 0 GROUP BY p.patient_id""",
    "history_lines": """
        SELECT patient_id, id, concat('- id=', id, ' ', valid_from, coalesce(' → ' || valid_to, ''), CASE WHEN status = 'active' THEN ' [CURRENT] ' ELSE concat(' [', status, '] ') END, subject, '/stated: ', value, ' (source: ', source, ')',
               CASE WHEN percent < 100 THEN printf(' conf=%.2f', percent / 100) ELSE '' END, coalesce(' reason: ' || reason, '')) AS line FROM o_ledger""",
    "fact_short": """
        SELECT id, concat('[', CAST(id AS VARCHAR)[:8], '] ', subject, '/stated: ', value, ' (', valid_from, coalesce('→' || valid_to, ''), ', ', status, ', src=', source, ')') AS short,
               concat('On ', valid_from, ', patient ', patient_id, ' stated ', subject, ': ', value, ' (source ', source, ').') AS sentence FROM o_ledger""",
    "upload_format": """
        SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'csv' WHEN 4 THEN 'text' WHEN 6 THEN 'image' ELSE CASE WHEN page_id % 3 = 0 THEN 'fhir' ELSE 'text' END END AS format,
               CASE WHEN page_id % 7 = 6 THEN 'image/jpeg' ELSE 'image/png' END AS mime FROM pages""",
    "extracted_assertions": """
        SELECT id, resource_type, subject, predicate, value, date, analyte, reading, unit, abnormal_flag, drug, substance, reaction, severity, condition, relation, age_at_onset, relative_name, relative_dob, relative_mrn, factor, factor_value FROM o_made""",
    "document_facts": f"""
        SELECT m.id, d.patient_id, subject, predicate, value, coalesce(CAST(given || '-01' AS DATE), d.doc_date) AS valid_from,
               CASE WHEN m.id % 5 = 0 THEN 'lab' WHEN d.doc_id % 3 = 0 THEN 'Dr. Cole' ELSE 'unknown' END AS source, d.doc_id AS source_document, concat('Visit ', d.doc_id) AS document_title, resource_type
        FROM o_made m JOIN o_document d ON d.doc_id = m.doc_id""",
    "intake_route": """
        SELECT CASE WHEN id % 3 <> 0 AND value <> '' THEN 'structured' WHEN id % 2 = 0 THEN 'text' ELSE 'error' END AS way, count(*) AS n, min(id) AS first FROM v_chart GROUP BY 1""",
    "merged_identity": """
        SELECT CAST(floor(id / 5) AS BIGINT) AS doc_id, first(relative_name ORDER BY id) FILTER (WHERE id % 3 = 0 AND relative_name IS NOT NULL) AS name, CAST(first(relative_dob ORDER BY id) FILTER (WHERE relative_dob IS NOT NULL) AS VARCHAR) AS dob,
               first(relative_mrn ORDER BY id) FILTER (WHERE relative_mrn IS NOT NULL) AS mrn, CAST(first(patient_id ORDER BY id) FILTER (WHERE id % 7 = 0) AS VARCHAR) AS ref FROM v_chart GROUP BY 1""",
    "csv_identity": "SELECT CAST(floor(id / 5) AS BIGINT) AS doc_id, coalesce(trim(first(coalesce(relative_mrn, '') ORDER BY id)), '') AS mrn, CAST(first(patient_id ORDER BY id) AS VARCHAR) AS ref FROM v_chart GROUP BY 1",
    "upload_split": """
        SELECT u.doc_id AS upload_id, CASE WHEN u.doc_id % 13 <> 0 THEN p.doc_id END AS duplicate_of, CASE WHEN u.doc_id % 13 <> 0 THEN p.name END AS duplicate_name
        FROM documents u LEFT JOIN (SELECT h, doc_id, v.name FROM (SELECT coalesce(text, '') AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1) JOIN v_patient v ON v.patient_id = doc_id * 3) p
          ON p.h = coalesce(u.text, '') AND floor(p.doc_id / 100) < floor(u.doc_id / 100)""",
    "ingest_plan": """
        SELECT patient_id, doc_id, CASE WHEN n > 0 THEN 'ALREADY' ELSE 'ingest' END AS way, n AS facts FROM (
          SELECT d.patient_id, d.doc_id, count(c.id) AS n FROM o_document d LEFT JOIN v_chart c ON c.patient_id = d.patient_id AND c.source_document = d.doc_id AND c.id % 3 = 0 GROUP BY 1, 2)
        UNION ALL SELECT patient_id, doc_id * 1000 + 7, 'missing', NULL FROM o_document""",
    "ingest_outcomes": """
        SELECT CAST(floor(id / 7) AS BIGINT) AS doc_id, count(*) AS facts, last(cls ORDER BY id) AS classification, coalesce('about ' || last(target ORDER BY id) FILTER (WHERE cls <> 'NEW'), '') AS reason,
               bool_or(cls IN ('SUPERSEDES', 'CONTRADICTS')) AS healed, NOT bool_or(cls IN ('SUPERSEDES', 'CONTRADICTS')) AS naive FROM o_verdict GROUP BY 1""",
    "batch_pins": """
        SELECT CAST(floor(a.id / 7) AS BIGINT) AS batch, a.id AS place, (SELECT first(b.patient_id ORDER BY b.id) FROM v_order b WHERE floor(b.id / 7) = floor(a.id / 7) AND b.id <= a.id AND b.id % 3 <> 0) AS chart, a.id % 3 <> 0 AS ok FROM v_order a""",
    "memory_nodes": """
        SELECT CAST(id AS VARCHAR) AS id, CASE id % 5 WHEN 0 THEN concat('n', id) WHEN 1 THEN subject WHEN 2 THEN 'Day' ELSE 'Timestamp' END AS label, CASE id % 5 WHEN 0 THEN 'Fact' WHEN 1 THEN 'Doc' ELSE '' END AS type FROM v_chart""",
    "memory_edges": "SELECT CASE WHEN id % 3 < 2 THEN CAST(id AS VARCHAR) ELSE '' END AS source, CASE id % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE '' END AS target, CASE id % 3 WHEN 0 THEN 'OF' WHEN 1 THEN 'l' ELSE '' END AS type FROM v_chart",
    "entry_texts": "SELECT id, CASE WHEN id % 5 = 1 THEN subject END AS text FROM v_chart",
    "timeline_facts": f"""
        SELECT id, patient_id, subject, predicate, value, valid_from, CASE WHEN id % 2 = 0 THEN source ELSE 'unknown' END AS source, value AS raw_text, type AS resource_type
        FROM v_chart LEFT JOIN (VALUES {_values(list(V.RESOURCE_TYPES.items()))}) AS t(s, type) ON s = lower(subject)""",
    "memory_answers": """
        SELECT coalesce(n.patient_id, s.patient_id) AS patient_id, coalesce(naive, '') AS naive, coalesce(smart, '') AS smart
        FROM (SELECT patient_id, string_agg(concat(subject, ' ', bucket), '; ' ORDER BY valid_from, id) AS naive FROM o_verdict
              WHERE floor(id / 7) NOT IN (SELECT floor(id / 7) FROM o_verdict WHERE cls IN ('SUPERSEDES', 'CONTRADICTS')) GROUP BY 1) n
        FULL JOIN (SELECT patient_id, string_agg(label, '; ' ORDER BY valid_from, id) AS smart FROM o_ledger WHERE status = 'active' GROUP BY 1) s ON s.patient_id = n.patient_id""",
    "memory_recalled": """
        SELECT q.vec_id AS query_id, sha256(coalesce(t, 'No memory matches.')) AS text_sha256 FROM embeddings q LEFT JOIN (
          SELECT query_id, string_agg(coalesce(text, ''), chr(10) ORDER BY place) AS t FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM (
              SELECT a.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) AS similarity FROM embeddings e, embeddings a WHERE a.vec_id % 50 = 0)
          ) JOIN documents ON doc_id = vec_id WHERE place <= 5 GROUP BY query_id) ON query_id = q.vec_id WHERE q.vec_id % 50 = 0""",
    "turn_rollup": """
        SELECT turn_id, coalesce(string_agg(chip, ',' ORDER BY seq) FILTER (WHERE chip <> ''), '') AS actions, last(fact_id ORDER BY seq) FILTER (WHERE fact_id IS NOT NULL) AS fact_id,
               CASE max(rank) WHEN 2 THEN 'contested' WHEN 1 THEN 'low_confidence' ELSE 'settled' END AS certainty, first(pending ORDER BY seq) FILTER (WHERE pending IS NOT NULL) AS pending,
               coalesce(string_agg(concat(seq, ',', seq + 1), ',' ORDER BY seq) FILTER (WHERE seq % 2 = 0), '') AS citations, coalesce(string_agg(chip, ',' ORDER BY seq) FILTER (WHERE seq % 3 = 0), '') AS cards FROM o_call GROUP BY turn_id""",
    "message_meta": "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'contested' ELSE 'settled' END AS certainty, CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END AS citations, 0 AS cards, CASE WHEN turn % 3 = 0 THEN 'p' END AS pending FROM conversations",
    "audit_log": """
        SELECT CASE WHEN turn % 3 <> 0 THEN role ELSE 'unknown' END AS doctor, conv_id AS patient_id, concat('turn ', turn) AS action, coalesce(text[:500], '') AS decision,
               CASE WHEN conv_id % 2 = 0 THEN concat('[', conv_id, ',', conv_id + 1, ']') ELSE '[]' END AS evidence_ids FROM conversations""",
    "writes_once": """
        SELECT key, seq, CASE WHEN key LIKE '%a' THEN 'before' ELSE first(CAST(conv_id AS VARCHAR)) OVER (PARTITION BY key ORDER BY seq) END AS result, key LIKE '%a' OR row_number() OVER (PARTITION BY key ORDER BY seq) > 1 AS deduped
        FROM (SELECT conv_id, conv_id * 1000 + turn AS seq, sha256(concat(lower(trim(role)), chr(31), turn % 3)) AS key FROM conversations)""",
    "thread_delete": "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 3)",
    "chat_index_points": "SELECT c.conv_id, c.turn FROM conversations c WHERE role = 'user' AND least(20, (SELECT count(*) FROM conversations b WHERE b.conv_id = c.conv_id AND b.turn < c.turn)) % 5 = 0",
}


def oracle_sql() -> dict[str, str]:
    every = QUERIES | {"door_facts": QUERIES["document_facts"]}
    return {name: with_views(sql, VIEWS).replace("AS STRING)", "AS VARCHAR)") for name, sql in every.items()}
