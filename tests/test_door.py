"""Documents through the door: what a batch leaves in the stored tables, and batches that come again."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from carefold.storage import shared_dir
from carefold.streaming.door import Door

FOUND = ["id", "resource_type", "value", "date", "cleared", "substance", "reaction", "severity", "drug", "condition", "analyte", "numeric_value", "unit", "ref_range", "abnormal_flag", "relation", "age_at_onset", "factor", "relative_name", "relative_dob", "relative_mrn"]
KINDS = {"id": "long", "cleared": "boolean", "numeric_value": "double", "age_at_onset": "long"}
SCHEMA = f"doc_id long, patient_id long, doc_date string, author string, title string, text string, content string, found array<struct<{', '.join(f'{c}: {KINDS.get(c, 'string')}' for c in FOUND)}>>"
PEOPLE = [(1, 1, "Ann Cole", datetime.date(1950, 1, 1), "M-1"), (2, 2, "Bo Cole", datetime.date(1980, 1, 1), "M-2"), (3, 3, "Cy Cole", datetime.date(1982, 1, 1), "M-3")]


def row(i: int, **more) -> tuple:
    return tuple(({"id": i} | more).get(c) for c in FOUND)


def document(n: int, patient: int, content: str, *found: tuple) -> tuple:
    return (n, patient, "2024-01-0" + str(n), "Dr. A", f"t{n}", "text", content, list(found))


FIRST = [
    document(1, 2, "one", row(10, resource_type="Allergy", substance="latex", value="latex"), row(11, resource_type="FamilyHistory", relation="mother", condition="stroke", relative_name="Ann Cole", relative_mrn="m-1")),
    document(2, 3, "two", row(12, resource_type="Medication", drug="metformin", value="metformin", date="2023-05")),
    document(3, 3, "two", row(13, resource_type="Condition", condition="gout", value="gout")),
]
SECOND = [
    document(4, 3, "one", row(14, resource_type="Condition", condition="gout", value="gout")),  # known by its content
    document(5, 2, "five", row(15, resource_type="FamilyHistory", relation="parent", condition="stroke", relative_mrn="M-1"), row(16, resource_type="FamilyHistory", relation="sister", condition="stroke", relative_mrn="M-3")),
]


@pytest.fixture
def door(spark):
    return Door(spark, shared_dir(spark, "door"), spark.createDataFrame(PEOPLE, "patient_id long, ord long, name string, dob date, mrn string"), F.to_date(F.lit("2025-01-01")), buckets=4)


def state(door):
    facts = {r.id: (r.patient_id, r.subject, r.value, str(r.valid_from), r.source_document) for r in door.facts.read().collect()}
    links = {(r.patient_id, r.relative_id): r.relation for r in door.links.read().collect()}
    return facts, links, {r.doc_id for r in door.index.read().collect()}


def test_batches_in_turn_and_again(spark, door):
    docs = lambda rows: spark.createDataFrame(rows, SCHEMA)
    door.take(docs(FIRST), ("s", 0))
    facts, links, index = state(door)
    assert facts == {10: (2, "allergy", "latex", "2024-01-01", 1), 11: (2, "family", "Mother: stroke", "2024-01-01", 1), 12: (3, "medication", "metformin", "2023-05-01", 2), 13: (3, "diagnosis", "gout", "2024-01-03", 3)}
    assert links == {(2, 1): "mother", (1, 2): "child"} and index == {1, 3}
    door.take(docs(SECOND), ("s", 1))
    facts, links, index = after = state(door)
    assert set(facts) == {10, 11, 12, 13, 15, 16} and index == {1, 3, 5}
    assert links == {(2, 1): "mother", (1, 2): "child", (2, 3): "sister", (3, 2): "sibling"}
    versions = [t.versions()[-1] for t in (door.facts, door.links, door.index)]
    door.take(docs(SECOND), ("s", 1))  # the same batch
    door.take(docs(FIRST), ("another", 0))  # the same documents in another stream
    door.take(docs([]), ("s", 2))
    assert state(door) == after and [t.versions()[-1] for t in (door.facts, door.links, door.index)] == versions


@pytest.mark.parametrize("broken", ["links", "index"])
def test_a_batch_that_broke_off(spark, door, monkeypatch, broken):
    """Whatever was merged by then, the batch done again gives what it would have given at once."""
    docs = spark.createDataFrame(FIRST, SCHEMA)

    def fail(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(getattr(door, broken), "merge", fail)
        with pytest.raises(OSError, match="lost"):
            door.take(docs, ("s", 0))
    assert len(state(door)[0]) == 4 and state(door)[2] == set()
    facts = door.facts.versions()
    door.take(docs, ("s", 0))
    assert state(door)[1:] == ({(2, 1): "mother", (1, 2): "child"}, {1, 3}) and door.facts.versions() == facts


def test_a_stream(spark, door):
    to = shared_dir(spark, "door-in")
    for rows in (FIRST, SECOND):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{to}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{to}/in")
    door.run(stream, f"{to}/a").awaitTermination()
    after = state(door)
    assert set(after[0]) == {10, 11, 12, 13, 15, 16} and len(after[1]) == 4
    door.run(stream, f"{to}/b").awaitTermination()  # from the beginning, without the first run's memory
    assert state(door) == after
