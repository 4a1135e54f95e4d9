"""Registry and chart files: order, unreadable files, groups; what is written is read back."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from carefold.sources import chart_files as C


@pytest.fixture
def folder(tmp_path):
    def put(name: str, content: object) -> None:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content if isinstance(content, str) else json.dumps(content))

    put("patients.json", {"patients": [{"patient_id": "P1", "name": "Ann", "mrn": 5}, "no entry", {"patient_id": "P2"}]})
    put("patients_user.json", {"patients": [{"patient_id": "P0", "name": "é", "extra": [1]}]})
    put("registry/seed/b.json", {"patients": [{"patient_id": "P3"}]})
    put("registry/seed/a.json", {"other": 1})
    put("registry/seed/c.json", '{"patients": [')
    put("registry/user/d.json", {"patients": 3})
    put("registry/user/e.json", "[1, 2]")
    put("registry/user/notes.txt", "none")
    put("charts/P1/documents.json", {"documents": [{"doc_id": "D2", "date": "2024-02", "text": "b"}, {"doc_id": "D1", "date": "2024-01-05", "asserts": [{"value": "x"}]}, {"doc_id": "D0"}]})
    put("charts/P1/uploads/U2.json", {"doc_id": "U2", "date": "2024-02", "uploaded": True})
    put("charts/P1/uploads/U1.json", {"doc_id": "U1", "date": "2024-02", "patient_id": "other"})
    put("charts/P1/uploads/U3.json", "broken")
    put("charts/P2/uploads/U4.json", {"doc_id": "D1", "date": "2023"})
    put("elsewhere/x.json", {"patients": [{"patient_id": "P9"}]})
    return f"file://{tmp_path}"


def test_registry(spark, folder):
    got = [(r.ord, r.source, r.patient_id, r.name, r.mrn) for r in C.registry(spark, folder).orderBy("ord").collect()]
    assert got == [(1, 0, "P1", "Ann", "5"), (2, 0, "P2", None, None), (3, 0, "P3", None, None), (4, 1, "P0", "é", None)]


@pytest.mark.parametrize("files", [1, 2, 512])
def test_documents(spark, folder, monkeypatch, files):
    monkeypatch.setattr(C, "GROUP_FILES", files)
    got = [(r.patient_id, r.place, r.doc_id, r.uploaded) for r in C.documents(spark, folder).orderBy("patient_id", "place").collect()]
    assert got == [("P1", 1, "D0", None), ("P1", 2, "D1", None), ("P1", 3, "D2", None), ("P1", 4, "U1", None), ("P1", 5, "U2", True), ("P2", 1, "D1", None)]
    assert [json.loads(r.asserts) for r in C.documents(spark, folder).filter("asserts IS NOT NULL").collect()] == [[{"value": "x"}]]


def test_unreadable(spark, folder):
    assert sorted(map(tuple, C.unreadable(spark, folder).collect())) == [("documents", 1, 1), ("registry", 0, 2), ("registry", 1, 2)]


def test_document_by_id(spark, folder):
    asked = spark.createDataFrame([("D1", 1), ("U2", 2), ("none", 3), (None, 4)], "doc_id string, q int")
    got = {r.q: (r.doc_id, r.patient_id, r.date) for r in C.document_by_id(asked, C.documents(spark, folder)).collect()}
    assert got == {1: ("D1", "P1", "2024-01-05"), 2: ("U2", "P1", "2024-02"), 3: ("none", None, None), 4: (None, None, None)}


def test_groups_hold_few_files(folder):
    groups = C.ChartReader(folder, "documents").partitions()
    assert [len(g.files) for g in groups] == [5]


def test_no_folder(spark, tmp_path):
    assert C.registry(spark, f"file://{tmp_path}/none").collect() == [] and C.documents(spark, f"file://{tmp_path}/none").collect() == []


def test_written_and_read(spark, tmp_path):
    to = f"file://{tmp_path}/made"
    people = spark.createDataFrame([(f"P{i}", f"M{i}", f"n{i}", None, "f", "s", i // 4) for i in range(10)], "patient_id string, mrn string, name string, dob string, sex string, summary string, file long")
    docs = spark.createDataFrame([(f"P{i % 3}", f"D{i}", f"text\n“{i}”") for i in range(9)], "patient_id string, doc_id string, text string").select("patient_id", F.struct("doc_id", "text").alias("document"))
    n = C.write_files(C.as_registry(people, "user"), to) + C.write_files(C.as_documents(docs.filter("document.doc_id < 'D6'")), to)
    n += C.write_files(C.as_uploads(docs.filter("document.doc_id >= 'D6'")), to)
    assert n == 3 + 3 + 3
    assert [(r.ord, r.patient_id) for r in C.registry(spark, to).orderBy("ord").collect()] == [(i + 1, f"P{i}") for i in range(10)]
    got = [(r.patient_id, r.doc_id, r.text) for r in C.documents(spark, to).orderBy("patient_id", "place").collect()]
    assert got == [(f"P{p}", f"D{i}", f"text\n“{i}”") for p in range(3) for i in range(p, 9, 3)]
    # Written again, nothing changes; no half files are left.
    C.write_files(C.as_uploads(docs.filter("document.doc_id >= 'D6'")), to)
    assert C.documents(spark, to).count() == 9 and not [p for p in (tmp_path / "made").rglob(".*") if not p.name.endswith(".crc")]
