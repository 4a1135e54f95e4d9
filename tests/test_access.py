"""Who may see whom, by wards: against loops over all pairs, and without pairs in the plan's rows."""

from carefold.operators import identity
from carefold.plans import clinic

DOCTORS = [(d, f"w{d % 4}") for d in range(12)] + [(1, "w2"), (1, "w2"), (2, None), (None, "w1"), (90, "nowhere"), (3, "w0")]
PATIENTS = [(p, f"w{p % 5}") for p in range(60)] + [(7, "w1"), (7, "w3"), (8, "w3"), (9, None), (None, "w1")]
ALLOWED = {(d, p) for d, w in DOCTORS for p, v in PATIENTS if w is not None and w == v and d is not None and p is not None}


def wards(spark):
    return spark.createDataFrame(DOCTORS, "doctor_id long, ward string"), spark.createDataFrame(PATIENTS, "patient_id long, ward string")


def test_scopes_like_loops(spark):
    got = sorted(tuple(r) for r in identity.scopes(wards(spark)).select("doctor_id", "patients", "first", "last").collect())
    own = {d: [p for e, p in ALLOWED if e == d] for d in {d for d, _ in ALLOWED}}
    assert got == sorted((d, len(p), min(p), max(p)) for d, p in own.items())
    pairs = spark.createDataFrame(sorted(ALLOWED) * 2, "doctor_id long, patient_id long")
    assert sorted(tuple(r) for r in identity.scopes(pairs).select("doctor_id", "patients", "first", "last").collect()) == got


def test_gate_like_loops(spark):
    asked = [(d, p, "x") for d in (*range(13), 90, 91, None) for p in (*range(0, 62, 3), 7, 8, None)]
    got = identity.gate(spark.createDataFrame(asked, "doctor_id long, patient_id long, more string"), wards(spark)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((*row, row[:2] in ALLOWED) for row in asked), key=repr)


def test_search_by_wards_like_by_pairs(spark):
    people = [(i, i, f"Ann {i % 7}" if i % 6 else None, None, f"MRN-{900 + i}") for i in range(70)]
    registry = spark.createDataFrame(people, "patient_id long, ord long, name string, dob date, mrn string")
    asked = [(d, q) for d in (*range(4), 90, 91) for q in ("ann 3", "ANN", "mrn-907", "7", "nobody", " ", None)]
    queries = spark.createDataFrame(asked, "doctor_id long, query string")
    pairs = spark.createDataFrame(sorted(ALLOWED), "doctor_id long, patient_id long")
    by_ward, by_pair = (sorted(map(tuple, identity.search(queries, registry, of).collect()), key=repr) for of in (wards(spark), pairs))
    assert by_ward == by_pair and len({r[2] for r in by_ward}) > 3


def test_pairs_are_counted_and_not_made(spark):
    """2,000 doctors and 500,000 patients of one ward: a thousand million pairs."""
    doctors, patients = spark.range(2000).selectExpr("id AS doctor_id", "'w' AS ward"), spark.range(500_000).selectExpr("id AS patient_id", "'w' AS ward")
    of = identity.scopes((doctors, patients)).selectExpr("count(*)", "min(patients)", "max(patients)", "max(last)").first()
    assert tuple(of) == (2000, 500_000, 500_000, 499_999)
    people = patients.selectExpr("patient_id", "patient_id AS ord", "concat('Ann ', patient_id % 3) AS name", "CAST(NULL AS DATE) AS dob", "'M' AS mrn")
    found = identity.search(doctors.selectExpr("doctor_id", "explode(array('ann 1', '')) AS query"), people, (doctors, patients))
    assert sorted(map(tuple, found.groupBy("query", "candidates").count().collect())) == [("", 500_000, 2000), ("ann 1", 166_667, 2000)]


def test_queries_have_their_sql_s_rows(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert clinic.QUERIES["access_scope"](spark, sf_dir).columns == ["doctor_id", "patients", "first", "last"]
    assert clinic.access_gate(spark, sf_dir).columns == ["id", "doctor_id", "patient_id", "answer"]
