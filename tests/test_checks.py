"""Checks on small charts made by hand, each case with what a clinician would expect, and by loops over derived charts."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from carefold.functions import clinical as C
from carefold.operators import checks, evidence
from carefold.plans import clinic

SCHEMA = """id long, patient_id long, valid_from date, resource_type string, subject string, predicate string, value string, status string, analyte string, reading double, abnormal_flag string,
            drug string, substance string, reaction string, severity string, condition string, relation string, age_at_onset long, factor string"""  # fmt: skip
NAMES = [c.split()[0] for c in SCHEMA.split(",")]


def chart(spark, *rows: dict):
    made = []
    for i, row in enumerate(rows):
        full = {"id": i, "patient_id": 1, "valid_from": "2024-01-01", "subject": "s", "predicate": "p", "value": "v", "status": "active"} | row
        full["valid_from"] = datetime.date.fromisoformat(full["valid_from"])
        made.append(tuple(full.get(n) for n in NAMES))
    return spark.createDataFrame(made, SCHEMA)


def lab(analyte: str, day: str, reading: float | None, flag: str = "high", **more) -> dict:
    return {"resource_type": "LabResult", "analyte": analyte, "valid_from": day, "reading": reading, "abnormal_flag": flag} | more


def today(day: str = "2025-01-01"):
    return F.to_date(F.lit(day))


def cards(df) -> list[tuple[str, str]]:
    return sorted((r.check_id, r.summary) for r in df.collect())


@pytest.mark.parametrize(
    "labs,trend",
    [
        ([("hba1c", 7.1, "high"), ("hba1c", 7.8, "high")], "HBA1C rising: 7.1 → 7.8"),
        ([("hba1c", 7.8, "high"), ("hba1c", 7.1, "high")], None),  # better
        ([("egfr", 60.0, "low"), ("egfr", 45.0, "low")], "EGFR falling: 60 → 45"),
        ([("egfr", 45.0, "low"), ("egfr", 60.0, "low")], None),
        ([("hba1c", 7.1, "high"), ("hba1c", 9.0, "normal"), ("hba1c", 7.2, " H ")], None),  # one abnormal reading only
        ([("hba1c", 7.1, "high"), ("hba1c", 9.0, "therapeutic"), ("hba1c", 7.1, "critical")], None),  # first and last are equal
        ([("ldl", 160.0, "high"), ("ldl", None, "high"), ("ldl", 170.0, "abnormal")], "LDL rising: 160 → 170"),
    ],
)
def test_trends(spark, labs, trend):
    facts = chart(spark, *[lab(a, f"2024-0{i + 1}-01", v, flag) for i, (a, v, flag) in enumerate(labs)])
    found = cards(checks.trend_cards(checks.lab_series(facts, today())))
    assert [s for _, s in found] == ([trend] if trend else [])


GAP = lab("creatinine", "2024-01-01", 1.9)


@pytest.mark.parametrize(
    "more,day,gap",
    [
        ([], "2024-03-31", True),
        ([], "2024-03-30", False),  # 89 days
        ([lab("creatinine", "2024-02-01", 1.0, "normal")], "2025-01-01", False),
        ([lab("creatinine", "2024-01-01", 1.0, "normal")], "2025-01-01", True),  # of the same day: not later
        ([lab("creatinine", "2024-02-01", 1.0, "normal", status="retracted")], "2025-01-01", True),
        ([lab("egfr", "2024-02-01", 90.0, "normal")], "2025-01-01", True),
        ([{"resource_type": "Condition", "valid_from": "2024-02-01", "condition": "Chronic Kidney disease"}], "2025-01-01", False),
        ([{"resource_type": "Procedure", "valid_from": "2026-02-01", "value": "renal ultrasound"}], "2025-01-01", False),  # after today counts, too
        ([{"subject": "Referral", "valid_from": "2024-02-01", "value": "to nephrology"}], "2025-01-01", False),
        ([{"subject": "memo", "valid_from": "2024-02-01", "value": "to nephrology"}], "2025-01-01", True),
        ([{"resource_type": "Condition", "valid_from": "2024-02-01", "value": "asthma"}], "2025-01-01", True),
        ([lab("creatinine", "2024-01-05", 2.5)], "2025-01-01", False),  # a trend says it all
    ],
)
def test_gaps(spark, more, day, gap):
    facts = chart(spark, GAP, *more)
    found = cards(checks.gap_cards(checks.lab_series(facts, today(day)), facts))
    assert found == ([("followup_gap:gap:creatinine", "Abnormal CREATININE (1.9) with no follow-up")] if gap else [])


@pytest.mark.parametrize("analyte", ["ldl", "hdl", "cholesterol", "triglycerides", "bmi"])
def test_risk_factors_have_no_gap(spark, analyte):
    facts = chart(spark, lab(analyte, "2020-01-01", 5.0))
    assert checks.gap_cards(checks.lab_series(facts, today()), facts).collect() == []


@pytest.mark.parametrize(
    "allergy,drug,hit",
    [
        ("penicillin", "amoxicillin 500mg", True), ("penicillin", "Cephalexin", True), ("penicillin", "meropenem/vaborbactam", True), ("penicillin", "azithromycin", False),
        ("sulfamethoxazole", "trimethoprim-sulfamethoxazole", True), ("Peanut", "peanut oil", True), ("peanut", "peanuts", False), ("peanut oil", "peanut oil", False), ("latex", "zinc", False),
        ("aspirin", "ibuprofen 200mg", True), ("lisinopril", "losartan", False),
    ],
)
def test_conflicts(spark, allergy, drug, hit):
    facts = chart(spark, {"resource_type": "Allergy", "predicate": "diagnosed", "substance": allergy}, {"resource_type": "Medication", "drug": drug, "predicate": "prescribed"})
    assert (checks.allergy_cards(facts).count() == 1) == hit
    orders = spark.createDataFrame([(1, drug), (2, drug)], "patient_id long, drug string")
    screened = {r.patient_id: (r.verdict, r.cards) for r in checks.prescribe_screen(orders, facts).collect()}
    assert screened == {1: ("critical", 1) if hit else ("clear", 0), 2: ("clear", 0)}


@pytest.mark.parametrize("change", [{"predicate": " Cleared "}, {"status": "superseded"}, {"status": "retracted"}])
def test_allergies_that_do_not_count(spark, change):
    allergy = {"resource_type": "Allergy", "predicate": "diagnosed", "substance": "penicillin"}
    drug = {"resource_type": "Medication", "value": "amoxicillin 500mg"}
    assert checks.allergy_cards(chart(spark, allergy, drug)).count() == 1
    assert checks.allergy_cards(chart(spark, allergy | change, drug)).count() == 0
    assert checks.allergy_cards(chart(spark, allergy, drug | {"status": "contested"})).count() == 0


FATHER = {"resource_type": "FamilyHistory", "relation": " Father ", "condition": "Heart attack (myocardial infarction)", "age_at_onset": 49}
SMOKER = {"resource_type": "Lifestyle", "factor": "smoking", "value": "10 a day"}


@pytest.mark.parametrize(
    "rows,found",
    [
        ([FATHER, SMOKER], ["cardiovascular"]),
        ([FATHER], []),
        ([SMOKER], []),
        ([FATHER | {"age_at_onset": 55}, SMOKER], []),
        ([FATHER | {"age_at_onset": None}, SMOKER], []),
        ([FATHER | {"relation": "uncle"}, SMOKER], []),
        ([FATHER | {"status": "superseded"}, SMOKER], ["cardiovascular"]),
        ([FATHER, SMOKER | {"status": "retracted"}], []),
        ([FATHER, {"resource_type": "Lifestyle", "factor": "smoking", "value": "never"}], []),
        ([FATHER, {"resource_type": "Lifestyle", "value": "Non-smoker"}], []),
        ([FATHER, lab("ldl", "2024-01-01", 165.0)], ["cardiovascular"]),
        ([FATHER, lab("ldl", "2024-01-01", 165.0, "low")], []),
        ([FATHER | {"condition": "hypertension"}, SMOKER], []),
        ([FATHER | {"condition": "Type 2 Diabetes"}, FATHER | {"relation": "Mother", "condition": "breast cancer, left", "age_at_onset": 80}], ["metabolic", "oncologic"]),
    ],
)
def test_family_risk(spark, rows, found):
    assert [c for c, _ in cards(checks.risk_cards(chart(spark, *rows)))] == [f"combined_risk:{c}" for c in found]


def test_hereditary_cards_tell_names_with_consent_only(spark):
    own = [{"resource_type": "Condition", "patient_id": 2, "condition": c} for c in ("Stroke", "breast cancer", "asthma")]
    links = spark.createDataFrame([(1, 2, "father", True, 1), (3, 2, "mother", False, 2), (4, 5, "son", True, 3)], "patient_id long, relative_id long, relation string, consent boolean, ord long")
    people = spark.createDataFrame([(2, "Ann Cole")], "patient_id long, name string")
    got = {r.patient_id: r for r in checks.hereditary_cards(links, chart(spark, *own), people).collect()}
    assert set(got) == {1, 3} and got[1].check_id == got[3].check_id == "hereditary:cardiovascular"
    assert "Ann Cole" in got[1].detail and "Stroke, breast cancer" in got[1].detail
    assert not any(word in got[3].detail for word in ("Ann", "Cole", "Stroke", "cancer", "mother"))


def test_suggestions(spark):
    """What each card suggests to do, the first and the number of them."""
    rows = [{"resource_type": "Medication", "drug": "amoxicillin 500mg"}, {"resource_type": "Allergy", "predicate": "diagnosed", "substance": "penicillin"}, {"resource_type": "Medication", "drug": "zinc oxide"}, {"resource_type": "Allergy", "predicate": "diagnosed", "substance": "zinc"}]
    rows += [lab("hba1c", "2024-01-01", 7.0), lab("hba1c", "2024-02-01", 8.0), GAP, {"resource_type": "Lifestyle", "factor": "smoking", "value": "smokes"}]
    rows += [{"resource_type": "FamilyHistory", "relation": "father", "condition": "myocardial infarction", "age_at_onset": 49}, {"resource_type": "FamilyHistory", "relation": "mother", "condition": "type 2 diabetes"}]
    facts = chart(spark, *rows)
    series = checks.lab_series(facts, today())
    found = checks.allergy_cards(facts).unionByName(checks.trend_cards(series)).unionByName(checks.gap_cards(series, facts)).unionByName(checks.risk_cards(facts))
    got = {(r.check_id, r.suggestions[0], len(r.suggestions)) for r in found.collect()}
    assert got == {
        ("allergy", "Avoid amoxicillin and other beta lactam agents", 3), ("allergy", "Avoid zinc and other related agents", 3), ("followup_gap:trend:hba1c", "Review HBA1C management", 2),
        ("followup_gap:gap:creatinine", "Order a repeat CREATININE", 3), ("combined_risk:cardiovascular", "Assess 10-year cardiovascular risk", 3), ("combined_risk:metabolic", "Consider metabolic screening per family-history guidelines", 1),
    }


def test_orders(spark):
    """Of seven allergies to one drug the first five make cards, in the order of their days; a clear order says so."""
    rows = [{"resource_type": "Allergy", "predicate": "diagnosed", "substance": "penicillin", "reaction": f"r{i}", "valid_from": f"2024-01-{9 - i:02d}"} for i in range(7)]
    orders = spark.createDataFrame([(1, "amoxicillin 500mg"), (1, "zinc"), (1, "zinc"), (2, "amoxicillin 500mg")], "patient_id long, drug string")
    top = checks.prescribe_top(orders, chart(spark, *rows)).orderBy("place").collect()
    assert [(r.patient_id, r.drug, r.place, r.evidence) for r in top] == [(1, "amoxicillin 500mg", i + 1, [6 - i]) for i in range(5)]
    texts = {(r.patient_id, r.drug): r.text.split("\n") for r in checks.order_texts(orders, chart(spark, *rows)).collect()}
    assert set(texts) == {(1, "amoxicillin 500mg"), (1, "zinc"), (2, "amoxicillin 500mg")}
    found = texts[1, "amoxicillin 500mg"]
    assert len(found) == 6 and found[0].startswith("Prescribe-time safety findings") and found[1].startswith("- [CRITICAL] Do not prescribe amoxicillin — penicillin allergy: ") and "r6" in found[1]
    assert texts[1, "zinc"] == ["No allergy or contraindication found for zinc in this patient's records. This is a safety screen only — confirm dosing and interactions for your review."]


def test_brief_rows(spark):
    rows = [{"resource_type": "Condition", "valid_from": "2024-02-01"}, {"resource_type": "Condition", "valid_from": "2024-01-01"}, {"resource_type": "Vital"}, {"resource_type": None}, {"resource_type": "Vital", "status": "retracted"}, {"resource_type": "Note"}]
    assert sorted((r.section, r.place, r.id) for r in evidence.brief_rows(chart(spark, *rows)).collect()) == [("conditions", 1, 1), ("conditions", 2, 0), ("vitals", 1, 2)]


def test_years_and_files(spark):
    rows = [("1999-02-03", "P001", 1999, "01"), ("19", "7", None, "07"), (" 1999", "none", None, "01"), ("2001x", "P1x02", 2001, "102"), ("", "", None, "01"), (None, "000", None, "00"), ("12345", "P0100", 1234, "100")]
    for r in spark.createDataFrame(rows, "dob string, patient string, year int, file string").select(C.birth_year(F.col("dob")).alias("got"), C.timeline_file(F.col("patient")).alias("name"), "year", "file").collect():
        assert (r.got, r.name) == (r.year, f"patient_timeline_{r.file}.json")


def test_top_cards_are_stable(spark):
    rows = [(1, "warning", 3, 1), (1, "critical", 0, 9), (1, "warning", 1, 2), (1, "info", 0, 0), (1, "critical", 0, 3), (1, "warning", 1, 1)]
    made = spark.createDataFrame(rows, "patient_id long, indicator string, check_ord int, ord2 long").withColumns({"ord1": F.lit(0), "ord3": F.lit(0)})
    got = checks.top_cards(made).orderBy("place").collect()
    assert [(r.indicator, r.check_ord, r.ord2) for r in got] == [("critical", 0, 3), ("critical", 0, 9), ("warning", 1, 1), ("warning", 1, 2), ("warning", 3, 1)]


def test_gaps_of_derived_charts_by_loops(spark):
    sf = "/root/testdata/sf0.001"
    words = {"creatinine": ["creatinine", "renal", "kidney", "nephrolog", "egfr"], "egfr": ["egfr", "creatinine", "renal", "kidney", "nephrolog"], "potassium": ["potassium", "electrolyte"],
             "hba1c": ["hba1c", "a1c", "diabet", "glycemic", "glycaemic", "endocrin"], "inr": ["inr", "warfarin", "anticoag"]}
    day, want, trends = datetime.date(1998, 6, 30), set(), 0
    by_patient: dict[int, list] = {}
    for f in clinic.charts(spark, sf).collect():
        if f.status != "retracted":
            by_patient.setdefault(f.patient_id, []).append(f)
    for patient, own in by_patient.items():
        own.sort(key=lambda f: (f.valid_from, f.id))
        for analyte in {f.analyte for f in own if f.analyte}:
            bad = [f for f in own if f.analyte == analyte and f.abnormal_flag.strip().lower() in ("high", "low", "abnormal", "critical")]
            valued = [f.reading for f in bad if f.reading is not None]
            up_is_bad = analyte in ("hba1c", "ldl", "creatinine", "glucose", "potassium", "inr")
            if len(valued) > 1 and valued[0] != valued[-1] and (valued[-1] > valued[0]) == up_is_bad:
                trends += 1
                continue
            if not bad or analyte == "ldl" or (day - bad[-1].valid_from).days < 90:
                continue
            later = [f for f in own if f.valid_from > bad[-1].valid_from]
            said = [f"{f.value} {f.condition or ''}".lower() for f in later if f.resource_type in ("Procedure", "Condition") or f.subject.lower() in ("note", "referral", "followup", "plan")]
            if not any(f.analyte == analyte for f in later) and not any(w in t for t in said for w in words.get(analyte, [analyte])):
                want.add((patient, f"followup_gap:gap:{analyte}"))
    got = {(r.patient_id, r.check_id) for r in clinic.QUERIES["followup_gap"](spark, sf).collect()}
    assert want and got == want and trends == clinic.QUERIES["lab_trend_cards"](spark, sf).count()
