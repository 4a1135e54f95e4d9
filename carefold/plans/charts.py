"""Queries behind charts, timelines, approvals and vocabulary, in the catalog's form."""

from __future__ import annotations

from carefold.plans.catalog import TODAY

#: The day a chart is rewound to.
REWOUND = "DATE '1996-06-30'"

# A chart's lanes, and words of conditions that pass by themselves.
LANES = ["Allergy", "Condition", "Medication", "LabResult", "Vital", "Family", "Lifestyle", "Other"]
ACUTE = ["pneumonia", "urinary tract infection", " uti", "bronchitis", "influenza", "common cold", "gastroenteritis", "dental infection",
         "cellulitis", "sinusitis", "otitis media", "strep throat", "covid-19", "conjunctivitis", "ear infection", "flu"]

#: Pixels of a chart of 1000 by 560: the side margin, the width between margins, a nudge.
MARGIN, WIDTH, NUDGE, LANE_HEIGHT = 90, 820, 26, 70

GROUP = "CASE resource_type WHEN 'FamilyHistory' THEN 'Family' ELSE resource_type END"
LANE = f"CASE {GROUP} {' '.join(f'''WHEN '{name}' THEN {i}''' for i, name in enumerate(LANES))} ELSE {len(LANES) - 1} END"
LOOKS_ACUTE = "(" + " OR ".join(f"position('{w}' IN lower(subject)) > 0" for w in ACUTE) + ")"

#: What a person asks for by name.
TARGETS = ["metformin", "high ldl", "stroke or heart", "zzz"]

# Words in the last column of a printed result.
FLAG_WORDS = ["HIGH", "LOW", "NORMAL", "CRITICAL", "ABNORMAL", "BORDERLINE"]

#: A line of "Name: value" pairs with two or more spaces between them.
_PAIR = "[A-Z][A-Za-z ]{1,24}: *"
PAIRS = f"^{_PAIR}[^: ][^:]{{0,39}}(  +{_PAIR}[^: ][^:]{{0,39}})*$"

QUERIES = {
    # Charts of one patient's facts, for all patients at once.
    "graph_layout": f"""
        SELECT id, patient_id, lane, pixel + {NUDGE} * (row_number() OVER (PARTITION BY patient_id, lane, pixel ORDER BY id) - 1) AS x, {LANE_HEIGHT} * lane + {LANE_HEIGHT // 2} AS y
        FROM (SELECT id, patient_id, lane, {MARGIN} + CAST(floor((2 * {WIDTH} * days + span) / (2 * span)) AS BIGINT) AS pixel
              FROM (SELECT id, patient_id, {LANE} AS lane, @DAYS[low|valid_from] AS days, greatest(1, @DAYS[low|high]) AS span
                    FROM (SELECT *, min(valid_from) OVER (PARTITION BY patient_id) AS low, max(valid_from) OVER (PARTITION BY patient_id) AS high FROM v_episode)))""",
    "graph_visible_edges": """
        SELECT source, target, kind FROM v_edge
        WHERE source IN (SELECT id FROM v_fact WHERE resource_type NOT IN ('LabResult', 'Allergy'))
          AND target IN (SELECT id FROM v_fact WHERE resource_type NOT IN ('LabResult', 'Allergy'))""",
    "graph_neighborhood": """
        SELECT node, @LISTAGG[CAST(other AS STRING)|','|other] AS neighbours, count(*) AS degree FROM (
          SELECT source AS node, target AS other FROM v_edge UNION SELECT target, source FROM v_edge) GROUP BY node""",
    "timeline_bounds": f"""
        SELECT patient_id, low - CAST(greatest(30, ceil(@DAYS[low|{TODAY}] * 4 / 100)) AS INT) AS opens, {TODAY} + 90 AS closes
        FROM (SELECT p.patient_id, coalesce(min(f.valid_from), {TODAY} - 365) AS low
              FROM v_patient p LEFT JOIN v_episode f ON f.patient_id = p.patient_id GROUP BY p.patient_id)""",
    "timeline_shapes": f"""
        SELECT id, patient_id, grp, shape, CASE WHEN shape = 'range' THEN coalesce(valid_to, {TODAY}) END AS until,
               CASE WHEN valid_from > {REWOUND} THEN 'future' WHEN valid_to <= {REWOUND} THEN 'replaced' ELSE 'active' END AS status
        FROM (SELECT *, CASE WHEN grp IN ('Vital', 'Family') THEN 'point'
                WHEN valid_to IS NULL AND (@DAYS[valid_from|{TODAY}] < 1 OR grp = 'Condition' AND {LOOKS_ACUTE}) THEN 'point'
                WHEN valid_to IS NOT NULL AND @DAYS[valid_from|valid_to] < 90 THEN 'point' ELSE 'range' END AS shape
              FROM (SELECT *, {GROUP} AS grp FROM v_episode WHERE resource_type <> 'LabResult'))""",
    "rewind_positions": f"""
        SELECT patient_id, total_days, least(greatest(day, 0), total_days) AS selected, day >= total_days AS is_now
        FROM (SELECT patient_id, CAST(greatest(0, @DAYS[min(valid_from)|{TODAY}]) AS BIGINT) AS total_days, CAST(@DAYS[min(valid_from)|{REWOUND}] AS BIGINT) AS day FROM v_episode GROUP BY patient_id)""",
    "evidence_board": f"""
        SELECT patient_id, subject, @LISTAGG[concat(CAST(valid_from AS STRING), CASE WHEN valid_to <= {TODAY} THEN ' replaced' ELSE '' END)|'; '|valid_from, id] AS cards
        FROM v_episode GROUP BY patient_id, subject""",
    "brief_top_rows": """
        SELECT patient_id, resource_type, CAST(place AS BIGINT) AS place, id, subject FROM (
          SELECT *, row_number() OVER (PARTITION BY patient_id, resource_type ORDER BY valid_from DESC, id DESC) AS place FROM v_fact WHERE status = 'active')
        WHERE place <= 6""",
    "status_labels": """
        SELECT status, CASE status WHEN 'active' THEN 'Active' WHEN 'superseded' THEN 'Replaced' WHEN 'retracted' THEN 'Removed'
               ELSE concat(upper(substr(status, 1, 1)), substr(status, 2)) END AS label, count(*) AS facts FROM v_fact GROUP BY status""",
    "why_sentences": """
        SELECT id, CASE WHEN valid_to IS NOT NULL THEN concat('replaced on ', CAST(valid_to AS STRING))
               WHEN resource_type = 'LabResult' AND reading > before THEN 'rising' WHEN resource_type = 'LabResult' AND reading < before THEN 'falling'
               ELSE concat(subject, ' is current; nothing has replaced it') END AS sentence
        FROM (SELECT id, subject, resource_type, reading, CASE WHEN resource_type <> 'LabResult' THEN valid_to END AS valid_to,
                     lag(reading) OVER (PARTITION BY patient_id, resource_type, subject ORDER BY valid_from, id) AS before FROM v_episode)""",
    # Uploads.
    "inbox_remaining": """
        SELECT source, count(*) AS documents, CAST(sum(CASE WHEN f.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS remaining
        FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM v_fact) f ON f.doc_id = documents.doc_id GROUP BY source""",
    "batch_rollup": """
        SELECT source, CAST(sum(CASE WHEN failed THEN 0 ELSE 1 END) AS BIGINT) AS ok, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) AS BIGINT) AS failed,
               CAST(coalesce(sum(facts), 0) AS BIGINT) AS facts
        FROM (SELECT source, trim(coalesce(text, '')) = '' AS failed, CASE WHEN trim(coalesce(text, '')) <> '' THEN n END AS facts
              FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM v_fact GROUP BY doc_id) f ON f.doc_id = documents.doc_id) GROUP BY source""",
    # Headings, name-value lines, printed result tables and paragraphs of a document. A table starts at lines "Test" and
    # "Result", has three more header lines, and goes on by five lines a row while the fifth is a flag's word.
    "document_blocks": f"""
        SELECT doc_id, block, kind, @LISTAGG[line|' '|place] AS content FROM (
          SELECT *, CAST(sum(CASE WHEN kind = former AND kind <> 'heading' AND nth > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY place) AS BIGINT) AS block
          FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY place) AS former FROM (
            SELECT doc_id, place, line, nth, CASE WHEN line = '' AND NOT in_table THEN 'blank' WHEN in_table THEN 'table' WHEN regexp_like(raw, '{PAIRS}') AND position('. ' IN raw) = 0 THEN 'pairs'
                   WHEN regexp_like(line, '^[A-Z0-9]') AND NOT regexp_like(line, '[.,]$') AND NOT regexp_like(line, '^{_PAIR}[^ ]')
                        AND length(line) <= 60 AND length(line) - length(replace(line, ' ', '')) < 9 THEN 'heading' ELSE 'paragraph' END AS kind
            FROM (SELECT *, header IS NOT NULL AND coalesce(nth < 5 OR nth < coalesce(min(CASE WHEN nth >= 5 AND nth % 5 = 4 AND upper(line) NOT IN ({", ".join(f"'{w}'" for w in FLAG_WORDS)}) THEN nth - 4 END)
                                OVER (PARTITION BY doc_id, header), last + 1 - (last + 1) % 5), false) AS in_table
                  FROM (SELECT *, coalesce(place - header, place + 1) AS nth, max(place - header) OVER (PARTITION BY doc_id, header) AS last
                        FROM (SELECT *, max(CASE WHEN lower(line) = 'test' AND lower(next) = 'result' THEN place END) OVER (PARTITION BY doc_id ORDER BY place) AS header
                              FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY place) AS next
                                    FROM (SELECT doc_id, place, trim(line) AS raw, trim(@REPLACE[line|\\s+| ]) AS line
                                          FROM (SELECT doc_id, @LINES[text] FROM documents)))))))))
        WHERE kind <> 'blank' GROUP BY doc_id, block, kind""",
    # Approval: a proposal to forget a fact is decided once; later decisions change nothing.
    "approvals_once": """
        SELECT d.seq, d.pending_id, d.decision, CASE WHEN d.seq > o.first THEN 'already decided' WHEN d.decision = 'reject' THEN 'rejected'
               WHEN f.status = 'retracted' THEN 'already retracted' ELSE 'retracted' END AS outcome
        FROM v_decision d JOIN v_first_decision o ON o.pending_id = d.pending_id JOIN v_fact f ON f.id = d.pending_id""",
    "pending_open": """
        SELECT f.id AS pending_id, f.patient_id, f.subject FROM v_fact f LEFT JOIN v_first_decision d ON d.pending_id = f.id
        WHERE d.pending_id IS NULL AND f.predicate = 'reported'""",
    "access_gate": """
        SELECT r.id, r.doctor_id, r.patient_id, CASE WHEN a.patient_id IS NULL THEN 403 ELSE 200 END AS answer
        FROM (SELECT o_orderkey AS id, o_custkey AS patient_id, o_orderkey % 10 + 1 AS doctor_id FROM orders) r
        LEFT JOIN v_access a ON a.patient_id = r.patient_id AND a.doctor_id = r.doctor_id""",
    "fact_resolve": f"""
        SELECT patient_id, target, id FROM (
          SELECT f.patient_id, t.target, f.id, row_number() OVER (
                   PARTITION BY f.patient_id, t.target ORDER BY CASE WHEN position(t.target IN f.subject) > 0 THEN 0 ELSE 1 END, f.valid_from, f.id) AS place
          FROM (SELECT target, @WORDS[target] AS word FROM (VALUES {', '.join(f"('{t}')" for t in TARGETS)}) AS v(target)) t
          JOIN v_fact f ON position(t.word IN f.subject) > 0 WHERE f.status = 'active') WHERE place = 1""",
    # The closed vocabulary and what it learns: a label counts only if it is a known class, and a known term keeps its own.
    "vocabulary_learned": """
        SELECT drug AS term, class, false AS learned FROM d_drug
        UNION ALL
        SELECT t.term, min_by(t.class, t.seq), true FROM v_term t
        JOIN (SELECT DISTINCT class FROM d_drug) c ON c.class = t.class LEFT JOIN d_drug k ON k.drug = t.term
        WHERE k.drug IS NULL GROUP BY t.term""",
    # Conversations.
    "thread_titles": """
        SELECT conv_id, coalesce(min_by(substr(text, 1, 80), turn) FILTER (WHERE role = 'user'), '') AS title, max(turn) AS latest FROM conversations GROUP BY conv_id""",
    "model_roles": "SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'model' ELSE role END AS role, concat('[', role, '] ', text) AS content FROM conversations",
}
