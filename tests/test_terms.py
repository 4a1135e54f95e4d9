"""Near names against all pairs; grounding; facts that held on many days against the range join."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from carefold.operators import identity, learned, ledger, terms


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def nearest(term: str, names: set[str]) -> tuple[int, str] | None:
    return min(((d, n) for n in names if (d := distance(term, n)) <= max(len(term), len(n)) // 5), default=None)


@pytest.mark.parametrize("letters,longest", [("ab", 12), ("abcdefgh", 25), ("é漢a", 8)])
def test_close(spark, letters, longest):
    rnd = random.Random(len(letters))
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, longest)))
    names = {word() for _ in range(80)}

    def changed(x: str) -> str:
        for _ in range(rnd.randint(0, 1 + len(x) // 5)):
            i = rnd.randrange(len(x) + 1)
            x = rnd.choice([x[:i] + x[i + 1 :], x[:i] + rnd.choice(letters) + x[i:], x[:i] + rnd.choice(letters) + x[i + 1 :]])
        return x

    asked = {y for y in (changed(x) for x in sorted(names) * 3) if y} | {word() for _ in range(40)}
    found = terms.close(spark.createDataFrame([(x,) for x in asked] * 2 + [(None,), (" ",)], "term string"), spark.createDataFrame([(n,) for n in names] + [(None,), ("",)], "name string"))
    want = {x: n for x in asked if (n := nearest(x, names))}
    assert {r.term: (r.distance, r.name) for r in found.collect()} == want and len(want) > 30


def test_ground(spark):
    schema = "id long, resource_type string, drug string, substance string, analyte string, condition string, value string, extra int"
    rows = [(1, "Medication", "metfromin", None, None, None, "metfromin 500mg", 0), (2, "Medication", None, None, None, None, "zinc", 0), (3, "Condition", None, None, None, "Diabetis", "", 0), (4, None, None, None, None, None, " ", 0), (5, "LabResult", None, None, "hba1c", None, "8", 0)]
    names = spark.createDataFrame([("metformin",), ("Diabetes",), ("hba1c",)], "name string")
    got = {r.id: tuple(r)[1:] for r in terms.ground(spark.createDataFrame(rows, schema), names).collect()}
    assert got == {1: (False, None, None), 2: (False, None, None), 3: (True, "diabetes", 1), 4: (None, None, None), 5: (True, "hba1c", 0)}
    more = terms.ground(spark.createDataFrame([(1, "Medication", "metforminn", None, None, None, "x", 0)], schema), names).first()
    assert tuple(more) == (1, True, "metformin", 1)
    assert [tuple(r) for r in terms.ground(spark.createDataFrame(rows[:1], schema), names.filter("false")).collect()] == [(1, False, None, None)]


def test_held_on_like_the_range_join(spark):
    rnd = random.Random(4)
    day = lambda n: datetime.date(2019, 12, 1) + datetime.timedelta(n)
    facts = [(i, rnd.randrange(5) if i % 50 else None, day(a := rnd.randrange(900)), None if rnd.random() < 0.2 else day(a + rnd.choice([-3, 0, 1, 2, 7, 64, 500])), rnd.choice(["active", "superseded", "contested", "retracted"]), "note") for i in range(400)]
    facts += [(1000, 1, datetime.date(1, 1, 1), None, "active", "note"), (1001, 1, datetime.date(1, 1, 1), datetime.date(9999, 12, 31), "active", "note"), (1002, 1, None, None, "active", "note")]
    asked = [(rnd.randrange(6), day(rnd.randrange(-20, 1500)), "own") for _ in range(150)] + [(1, datetime.date(9999, 12, 30), "own"), (1, None, "own"), (None, day(3), "own")]
    given = spark.createDataFrame(facts, "id long, patient_id long, valid_from date, valid_to date, status string, extra string")
    days = spark.createDataFrame(asked, "patient_id long, day date, extra string")
    got = ledger.held_on(given, days)
    assert got.columns == ["patient_id", "day", "extra", "id", "valid_from", "valid_to", "status"]
    want = [(p, d, "own", i) for p, d, _ in asked for i, q, a, b, s, _ in facts if None not in (p, q, d, a) and p == q and s != "retracted" and a <= d and (b is None or d < b)]
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)
    one = ledger.snapshot(given, F.lit(day(200))).filter("patient_id IS NOT NULL")
    assert sorted(r.id for r in one.collect()) == sorted(r.id for r in ledger.held_on(given, spark.range(6).select(F.col("id").alias("patient_id"), F.lit(day(200)).alias("day"))).collect())


def test_within_like_all_pairs(spark):
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abé 1") for _ in range(rnd.randint(1, n)))
    texts, parts = {word(9) for _ in range(60)}, {word(5) for _ in range(60)}
    found = terms.within(spark.createDataFrame([(t,) for t in texts] * 2 + [(None,), ("",)], "text string"), spark.createDataFrame([(p,) for p in parts] + [(None,), ("",)], "part string"))
    assert sorted(map(tuple, found.collect())) == sorted((t, p) for t in texts for p in parts if p in t)


def test_search_like_loops(spark):
    names = ["Ann Cole", "ann o'neil", "Bo", None, "Mia Éa", "x"]
    people = [(i, i, names[i % 6], None, f"MRN-{900 + i}" if i % 4 else None) for i in range(40)]
    registry = spark.createDataFrame(people, "patient_id long, ord long, name string, dob date, mrn string")
    access = [(d, p) for d in range(3) for p in range(40) if (p + d) % 3] + [(0, 1), (5, 999)]
    asked = [(d, q) for d in (0, 1, 2, 5, 7) for q in ("ann", " ANN ", "o", "é", "mrn-9", "90", "7", "39", "nobody", "", " ", None, "mrn-9070")]
    found = identity.search(spark.createDataFrame(asked, "doctor_id long, query string"), registry, spark.createDataFrame(access, "doctor_id long, patient_id long"))
    want = []
    for d, q in asked:
        mine = [p for p in people if (d, p[0]) in set(access)]
        own = [] if q is None else [p[0] for p in mine if any(q.strip().lower() in x.lower() for x in (p[2], p[4]) if x is not None) or str(p[0]) == q.strip() or not q.strip()]
        want.append((d, q, len(own), own[0] if len(own) == 1 else None))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_search_has_no_nested_loop(spark):
    registry = spark.createDataFrame([(1, 1, "Ann", None, "M")], "patient_id long, ord long, name string, dob date, mrn string")
    plan = identity.search(spark.createDataFrame([(1, "a")], "doctor_id long, query string"), registry, spark.createDataFrame([(1, 1)], "doctor_id long, patient_id long"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


LEARNED = "kind string, term string, class string, day date, seq long, extra int"


@pytest.mark.parametrize(
    "kind,name,day,want",
    [
        ("drug", "Zornil 5mg", 5, (None, False)),  # not learned yet
        ("drug", "Zornil 5mg", 10, ("statin", True)),
        ("drug", "zornil", 20, ("nsaid", True)),  # learned anew
        ("drug", " Metformin", 1, ("biguanide", False)),
        ("drug", "metformin", 30, ("arb", True)),  # what is learned comes before the vocabulary
        ("drug", "oxo/zornil", 12, ("statin", True)),
        ("drug", "unclear", 30, (None, False)),  # its class is no class
        ("drug", "twice", 30, ("nsaid", True)),  # two of one day: the later one
        ("condition", "zornil", 30, (None, False)),  # of the other kind
        ("condition", "Severe gloom of old", 15, ("metabolic", True)),
        ("condition", "Severe gloom of old", 5, (None, False)),
        ("condition", "stroke and gloom", 15, ("cardiovascular", False)),  # the longer one
        ("condition", "gloom with deep gloom", 15, ("oncologic", True)),
        ("condition", "type 2 diabetes", 15, ("metabolic", False)),
        (None, "zornil", 15, (None, False)),
        ("drug", None, 15, (None, False)),
        ("drug", "zornil", None, (None, False)),
    ],
)
def test_classified_on_the_day(spark, kind, name, day, want):
    on = lambda n: None if n is None else datetime.date(2024, 1, n)
    known = [("drug", " ZORNIL", "statin", on(10), 1), ("drug", "zornil", "nsaid", on(20), 2), ("drug", "metformin", "arb", on(25), 3), ("drug", "unclear", "soup", on(1), 4), ("drug", "twice", "statin", on(1), 5), ("drug", "twice", "nsaid", on(1), 6)]
    known += [("condition", "gloom", "metabolic", on(10), 7), ("condition", "deep gloom", "oncologic", on(10), 8), ("condition", None, "metabolic", on(1), 9), ("drug", "zornil", "arb", None, 10), ("condition", "", "metabolic", on(1), 11)]
    facts = spark.createDataFrame([(1, kind, name, on(day), "x")], "id long, kind string, name string, day date, extra string")
    got = learned.classify_on(facts, spark.createDataFrame([(*r, 0) for r in known], LEARNED)).first()
    assert (got["class"], got.was_learned) == want and got.extra == "x"
