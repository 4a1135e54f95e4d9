"""Reconciliation, chains, retraction, identity, kinship, evidence and intake on small tables made by hand."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from carefold.functions import clinical as C
from carefold.operators import conversation, evidence, identity, intake, ledger, provenance
from carefold.plans import clinic

SAID = "id long, patient_id long, subject string, value string, valid_from date"


def day(n: int) -> datetime.date:
    return datetime.date(2024, 1, n)


def said(spark, *rows: tuple[str, int]):
    """Statements of one key: (value, day), in the order of their ids."""
    return spark.createDataFrame([(i, 1, "s", v, day(d)) for i, (v, d) in enumerate(rows)], SAID)


@pytest.mark.parametrize(
    "rows,verdicts,status,confidence",
    [
        ([("a", 1)], "NEW", "active", [0.8]),
        ([("a", 1), ("a", 2), ("a", 3)], "NEW CONSISTENT CONSISTENT", "active", [0.9]),
        ([("a", 1)] + [("a", 2)] * 9, "NEW" + " CONSISTENT" * 9, "active", [1.0]),
        ([("a", 1), ("b", 2)], "NEW SUPERSEDES", "superseded active", [0.8, 0.8]),
        ([("a", 1), ("b", 1)], "NEW CONTRADICTS", "contested contested", [0.5, 0.5]),
        # Contested facts are out: the third is new without a comparison, and the fourth contradicts that.
        ([("a", 1), ("b", 1), ("b", 1), ("c", 1)], "NEW CONTRADICTS NEW CONTRADICTS", "contested contested contested contested", [0.5] * 4),
        ([("a", 1), ("b", 1), ("a", 2)], "NEW CONTRADICTS NEW", "contested contested active", [0.5, 0.5, 0.8]),
        # A restatement keeps the first day, so another value of the later day supersedes.
        ([("a", 1), ("a", 2), ("b", 2)], "NEW CONSISTENT SUPERSEDES", "superseded active", [0.85, 0.8]),
    ],
)
def test_reconcile(spark, rows, verdicts, status, confidence):
    found = ledger.classify(said(spark, *rows)).orderBy("id").collect()
    assert " ".join(r.classification for r in found) == verdicts
    facts = ledger.reconcile(said(spark, *rows), 0.8).orderBy("id").collect()
    assert " ".join(f.status for f in facts) == status and [f.confidence for f in facts] == pytest.approx(confidence)
    for a, b in zip(facts, facts[1:], strict=False):
        assert (a.valid_to, a.superseded_by) == ((b.valid_from, b.id) if a.status == "superseded" else (None, None))


def test_reconcile_drops_what_has_no_key(spark):
    rows = [(1, None, "s", "a", day(1)), (2, 1, None, "a", day(1)), (None, 1, "s", "a", day(1)), (3, 1, "s", None, day(1)), (4, 1, "s", "a", None)]
    assert ledger.reconcile(spark.createDataFrame(rows, SAID)).collect() == []


def test_chains(spark):
    """A long chain, a cycle, a fact that points to itself, one that points nowhere, and one alone."""
    links = [(i, i + 1) for i in range(40)] + [(40, None), (50, 51), (51, 52), (52, 50), (60, 60), (70, 99), (80, None)]
    facts = spark.createDataFrame(links, "id long, superseded_by long")
    got = sorted(map(tuple, ledger.chains(facts, facts.select("id").union(spark.range(1000, 1001))).collect()))
    want = [(i, k - i, k) for i in range(41) for k in range(i, 41)] + [(50, 0, 50), (50, 1, 51), (50, 2, 52), (51, 0, 51), (51, 1, 52), (51, 2, 50), (52, 0, 52), (52, 1, 50), (52, 2, 51)]
    assert got == sorted(want + [(60, 0, 60), (70, 0, 70), (80, 0, 80)])


def test_chain_query_has_every_later_fact(spark):
    """A row for each fact and each one that came after it, not only a fact's place."""
    sf_dir = "/root/testdata/sf0.001"
    places = {r.id: r for r in clinic.QUERIES["supersession_rank"](spark, sf_dir).collect()}
    got = clinic.QUERIES["supersession_chain"](spark, sf_dir)
    assert got.columns == ["start", "step", "id"]
    assert got.count() == sum(r.length - r.position + 1 for r in places.values()) > len(places)


def test_ranked(spark):
    """A long chain, a cycle and what leads into it, a fact that points to itself, one that points nowhere, one alone, two with one successor."""
    links = [(i, i + 1) for i in range(3000)] + [(3000, None), (4001, 4002), (4002, 4003), (4003, 4001), (4000, 4001), (4010, 4010), (4020, 9999), (4030, None), (4040, 4042), (4041, 4042), (4042, None), (4043, 4040)]
    got = {r.id: tuple(r)[1:] for r in ledger.ranked(spark.createDataFrame(links, "id long, superseded_by long")).collect()}
    want = {i: (3000, i + 1, 3001) for i in range(3001)} | dict.fromkeys((4000, 4001, 4002, 4003, 4010), (None, None, None))
    want |= {4020: (4020, 1, 1), 4030: (4030, 1, 1), 4040: (4042, 2, 3), 4041: (4042, 2, 3), 4042: (4042, 3, 3), 4043: (4042, 1, 3)}
    assert got == want


def test_why_answers(spark):
    schema = "id long, patient_id long, subject string, label string, valid_from date, superseded_by long, status string, source string, reason string, reading double"
    rows = [(1, 1, "x", "x 1", day(1), 2, "superseded", "A", None, 1.0), (2, 1, "x", "x 2", day(2), None, "active", "B", "newer", 2.0)]
    rows += [(3 + i, 1, "lab ldl", f"ldl {i}", day(i + 1), None, "active", "C", None, 100.0 + i) for i in range(3)]
    got = {r.id: r for r in provenance.answers(spark.createDataFrame(rows, schema)).collect()}
    assert [(got[i].chain, got[i].position, got[i].length, got[i].replaced_by) for i in (1, 2, 3)] == [(2, 1, 2, 2), (2, 2, 2, None), (3, 1, 1, None)]
    assert (got[1].trend, got[2].trend_reason, got[2].siblings) == (None, None, 0)
    assert got[4].trend == "rising" and got[4].siblings == 3 and got[4].trend_reason.startswith("LDL is rising: 100 → 101 → 102 (2024-01-01 → 2024-01-03)")


FACT = "id long, valid_from date, valid_to date, superseded_by long, status string, reason string"


def test_retract(spark):
    facts = [(1, day(1), day(3), 3, "superseded", "x"), (2, day(2), day(3), 3, "retracted", None), (3, day(3), day(4), 4, "superseded", None), (4, day(4), None, None, "active", None)]
    gone = spark.createDataFrame([(3, "typo"), (9, "none")], "id long, reason string")
    got = {r.id: tuple(r)[2:] for r in ledger.retract(spark.createDataFrame(facts, FACT), gone).collect()}
    assert got[1] == (None, None, "active", "restored: superseding fact retracted (typo)")  # the first of the two that it superseded
    assert got[2] == (day(3), 3, "retracted", None) and got[3] == (day(4), 4, "retracted", "typo") and got[4] == (None, None, "active", None)
    # Once only: a retracted fact is not retracted again.
    again = ledger.retract(spark.createDataFrame(facts, FACT), gone)
    assert sorted(map(tuple, ledger.forget(again, gone).collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)


def test_snapshot(spark):
    facts = spark.createDataFrame([(1, day(1), day(3), 2, "superseded", None), (2, day(3), None, None, "contested", None), (3, day(1), None, None, "retracted", None), (4, day(5), day(4), 5, "superseded", None)], FACT)
    at = lambda n: sorted(r.id for r in ledger.snapshot(facts, F.lit(day(n))).collect())
    assert (at(1), at(2), at(3), at(4), at(5)) == ([1], [1], [2], [2], [2])


REGISTRY = "patient_id long, ord long, name string, dob date, mrn string"
PEOPLE = [(1, 1, "Rahul Sharma", datetime.date(1980, 5, 1), "MRN-1"), (2, 2, "Rahul  Sharma", datetime.date(1950, 1, 1), "MRN-2"), (3, 3, "rahul sharma", datetime.date(1978, 1, 1), " mrn-3"),
          (4, 4, "Ann O'Neil-Cole", None, ""), (5, 5, "Mia Sharma", datetime.date(1981, 1, 1), None)]


@pytest.mark.parametrize(
    "name,dob,mrn,found",
    [
        ("x", None, " MRN-3 ", 3), ("RAHUL SHARMA", None, None, 1), ("rahul-sharma", datetime.date(1950, 1, 1), "", 2), ("Rahul Sharma", datetime.date(1999, 1, 1), None, None),
        ("ann oneil cole", datetime.date(1990, 1, 1), None, 4), ("", None, "", None), (None, None, None, None), ("Rahul Sharma", None, "MRN-99", 1),
    ],
)
def test_find(spark, name, dob, mrn, found):
    asked = spark.createDataFrame([(7, name, dob, mrn)], "query_id long, name string, dob date, mrn string")
    assert identity.find(asked, spark.createDataFrame(PEOPLE, REGISTRY)).first().found == found


def test_resolve_makes_each_new_person_once(spark):
    asked = [(10, "New One", None, None), (11, "new one", None, ""), (12, "New One", datetime.date(2000, 1, 1), None), (13, "", None, "M-7"), (14, "Else", None, " m-7 "), (15, " ", None, None), (16, "Mia Sharma", None, None)]
    queries = spark.createDataFrame(asked, "query_id long, name string, dob date, mrn string")
    found, new = identity.resolve(queries, spark.createDataFrame(PEOPLE, REGISTRY))
    assert {r.query_id: (r.patient, r.created) for r in found.collect()} == {10: (6, True), 11: (6, True), 12: (7, True), 13: (8, True), 14: (8, True), 15: (None, False), 16: (5, False)}
    assert {r.patient_id: (r.name, r.mrn) for r in new.collect()} == {6: ("New One", "MRN-900006"), 7: ("New One", "MRN-900007"), 8: ("P008", "M-7")}


@pytest.mark.parametrize(
    "relation,name,dob,mrn,found",
    [
        ("father", "Rahul Sharma", None, None, (2, "high")),  # the others of that name are too young
        ("brother", "Rahul Sharma", None, None, (1, "medium")),  # two fit
        ("brother", "Rahul Sharma", datetime.date(1978, 1, 1), None, (3, "high")),
        ("son", "Rahul Sharma", None, None, None),  # nobody is young enough
        ("mother", "Ann O'Neil-Cole", None, None, (4, "medium")),  # no date of birth, another surname
        ("father", "nobody", None, "mrn-1", (1, "high")),
        ("sister", "Mia Sharma", None, "MRN-5", None),  # the patient is no relative
        ("father", "", None, None, None),
    ],
)
def test_match_relatives(spark, relation, name, dob, mrn, found):
    mention = spark.createDataFrame([(1, 5, day(1), relation, name, dob, mrn)], "fact_id long, patient_id long, valid_from date, relation string, name string, dob date, mrn string")
    got = [(r.relative_id, r.confidence) for r in identity.match_relatives(mention, spark.createDataFrame(PEOPLE, REGISTRY)).collect()]
    assert got == ([found] if found else [])


def test_links_and_consent(spark):
    made = [(1, 5, day(1), "father", 2, "high"), (2, 5, day(2), "brother", 3, "medium"), (3, 2, day(3), "daughter", 5, "medium"), (4, 5, day(4), "parent", 2, "medium")]
    links = identity.links(spark.createDataFrame(made, "fact_id long, patient_id long, valid_from date, relation string, relative_id long, confidence string"))
    want = {(5, 2): ("father", True), (2, 5): ("child", True), (5, 3): ("brother", False), (3, 5): ("sibling", False)}
    assert {(r.patient_id, r.relative_id): (r.relation, r.consent) for r in links.collect()} == want
    changes = spark.createDataFrame([(3, 5, True, 1), (2, 5, True, 1), (5, 2, False, 2)], "a long, b long, consent boolean, seq long")
    got = {(r.patient_id, r.relative_id): (r.consent, r.proposed) for r in identity.set_consent(links, changes).collect()}
    assert got == {(5, 2): (False, False), (2, 5): (False, False), (5, 3): (True, True), (3, 5): (True, True)}
    assert identity.links(spark.createDataFrame(made, "fact_id long, patient_id long, valid_from date, relation string, relative_id long, confidence string"), links).count() == 4


def test_numbered_over_partitions(spark):
    rows = identity.numbered(spark.range(1000).repartition(7).select((F.col("id") * 37 % 1000).alias("k")), "k")
    assert [(r.k, r.n) for r in rows.orderBy("k").collect()] == [(i, i + 1) for i in range(1000)]


def test_labels(spark):
    rows = [("allergy", "Cleared", "trimethoprim-sulfa o'x 5mg", "Trimethoprim-Sulfa O'X 5Mg allergy cleared"), ("Allergy", "diagnosed", "latex", "Allergic to latex"), ("medication", "switched", "x", "Switched to x"),
            ("medication", "stopped", "x", "On x"), ("diagnosis", "resolved", "gout", "Diagnosed: gout"), ("lab ldl", "mEASURED", "LDL 5", "Measured LDL 5")]
    df = spark.createDataFrame(rows, "s string, p string, v string, want string")
    for r in df.select(C.label(F.col("s"), F.col("p"), F.col("v")).alias("got"), "want").collect():
        assert r.got == r.want


@pytest.mark.parametrize("cited,certainty,want", [([1], "settled", "settled"), ([1, 2], "settled", "low_confidence"), ([2, 3], "settled", "contested"), ([4], "settled", "settled"), ([3], "low_confidence", "contested"), ([9], "settled", "low_confidence"), ([], "settled", "low_confidence")])
def test_certainty(spark, cited, certainty, want):
    facts = spark.createDataFrame([(1, "active", 0.9), (2, "active", 0.59), (3, "contested", 0.5), (4, "superseded", 0.1)], "id long, status string, confidence double")
    answers = spark.createDataFrame([(1, cited, certainty, "Yes..")], "answer_id long, cited array<long>, certainty string, text string")
    got = evidence.validate(evidence.enforce_certainty(answers, facts)).first()
    known = [c for c in cited if c != 9]
    assert got.certainty == want and got.grounded == len(known)
    assert got.text == ("Yes.." if known else f"Yes. {evidence.HEDGE}")


def test_upload_duplicates(spark):
    index = spark.createDataFrame([("a" * 64, "D0", 1)], "hash string, doc_id string, patient_id long").withColumn("hash", F.sha2(F.lit("same"), 256))
    index = index.union(index.select(F.sha2(F.lit("orphan"), 256), F.lit("D9"), F.lit(99).cast("long")))
    uploads = spark.createDataFrame([(1, "same", False), (2, "same", True), (3, "new", False), (4, "new", False), (5, "orphan", False), (6, None, None)], "upload_id long, content string, force boolean")
    got = {r.upload_id: (r.duplicate_of, r.duplicate_name) for r in intake.split_uploads(uploads, index, spark.createDataFrame(PEOPLE, REGISTRY)).collect()}
    assert got == {1: ("D0", "Rahul Sharma")} | dict.fromkeys((2, 3, 4, 5, 6), (None, None))


def test_outcomes_take_the_last_fact(spark):
    rows = [(1, 0, "SUPERSEDES", "a"), (1, 1, "NEW", ""), (2, 0, "NEW", None)]
    got = {r.doc_id: tuple(r)[1:] for r in intake.outcomes(spark.createDataFrame(rows, "doc_id long, place long, classification string, reason string")).collect()}
    assert got == {1: (2, "NEW", "a", True, False), 2: (1, "NEW", "", False, True)}


def test_formats(spark):
    rows = [("a.PDF", None, "pdf"), ("a.tiff", "", "image"), ("a.csv.txt", "", "text"), ("b.json", '{"resourceType":"Condition"}', "fhir"), ("b.json", '{"resourceType":"Patient"}', "text"), ("b.json", "[1]", "text"), ("b.json", "{", "text"), ("c", None, "text")]
    for r in spark.createDataFrame(rows, "n string, c string, want string").select(intake.sniff_format(F.col("n"), F.col("c")).alias("got"), "want", "n").collect():
        assert r.got == r.want, r.n


def test_broken_files_give_no_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"doc_id": "1", "n": 2}, {"doc_id": "2"}]')
    (tmp_path / "b.json").write_text("{no json")
    assert sorted(map(tuple, intake.read_json(spark, str(tmp_path), "doc_id string, n long").collect())) == [("1", 2), ("2", None)]


def test_why(spark):
    schema = "id long, patient_id long, subject string, label string, valid_from date, superseded_by long, status string, source string, reason string"
    facts = spark.createDataFrame([(1, 1, "x", "x 1", day(1), 2, "superseded", "A", None), (2, 1, "x", "x 2", day(2), None, "active", "B", "newer"), (3, 1, "y", "y 1", day(1), None, "active", "C", None), (4, 1, "y", "y 2", day(2), None, "active", "C", None), (5, 1, "z", "z", day(1), None, "active", "C", None)], schema)
    got = {r.id: tuple(r)[1:] for r in provenance.why(facts).collect()}
    assert got[1] == (2, "newer", "B", day(2), 0) and got[2] == (None, "newer", "B", day(2), 0) and got[3] == (None, "", "C", day(1), 2)
    told = {r.subject: (r.narrative, r.fact_id) for r in provenance.narratives(facts).collect()}
    assert told["x"] == ("Change history:\n• x 1 (2024-01-01, A) was replaced by x 2 (2024-01-02, B) — reason: newer\n\nCurrent state: x 2 (since 2024-01-02, source: B).", 1)
    assert told["y"] == ("No single record replaced another — y has 2 readings on file, each still active: y 1 (2024-01-01); y 2 (2024-01-02).", 4)
    assert told["z"] == ("Current: z (since 2024-01-01, source: C). No prior changes recorded.", 5)


def test_index_points_of_a_long_thread(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant") for t in range(28)]
    got = [r.turn for r in conversation.index_points(spark.createDataFrame(rows, "conv_id long, turn long, role string")).orderBy("turn").collect()]
    assert got == [0, 10, 20, 22, 24, 26]


def test_conform_and_upsert(spark):
    rows = ledger.conform(spark.createDataFrame([(1, "x")], "id int, extra string"), "id long, value string")
    assert rows.schema.simpleString() == "struct<id:bigint,value:string>"
    merged = ledger.upsert(rows, spark.createDataFrame([(1, "new"), (2, "b")], "id long, value string"))
    assert sorted(map(tuple, merged.collect())) == [(1, "new"), (2, "b")]
