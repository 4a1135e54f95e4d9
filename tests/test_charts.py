"""Document blocks on small texts with known blocks."""

from __future__ import annotations

import pytest

from carefold import registry

CASES = {
    "Discharge Summary\nMary Doe was seen today.\nShe is well,\nand went home.": [("heading", "Discharge Summary"), ("paragraph", "Mary Doe was seen today. She is well, and went home.")],
    "Patient: Mary Doe   MRN: 12\nDOB: 1960-01-02\n\nnote one\n\nnote  two": [("pairs", "Patient: Mary Doe MRN: 12 DOB: 1960-01-02"), ("paragraph", "note one"), ("paragraph", "note two")],
    "Plan: rest. Then walk and come back": [("paragraph", "Plan: rest. Then walk and come back")],
    "Test\nResult\nUnits\nRange\nFlag\nLDL\n165\nmg/dL\n0-99\nHIGH\nHbA1c\n5\n%\n4-6\nnormal\nand then prose.": [
        ("table", "Test Result Units Range Flag LDL 165 mg/dL 0-99 HIGH HbA1c 5 % 4-6 normal"), ("paragraph", "and then prose.")],
    "Labs\nNext Step\n": [("heading", "Labs"), ("heading", "Next Step")],
    "": [],
    None: [],
}


@pytest.fixture(scope="module")
def blocks(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("blocks")
    rows = [(i, text, "en", "web", 0) for i, text in enumerate(CASES)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{at}/documents.parquet")
    return registry.queries()["document_blocks"](spark, str(at)).orderBy("doc_id", "block").collect()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_blocks(blocks, i):
    assert [(r.kind, r.content) for r in blocks if r.doc_id == i] == list(CASES.values())[i]
