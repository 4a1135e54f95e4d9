"""Line dedup against a version of loops, and its SQL."""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest

from carefold.llm import linededup, quality
from tests.oracle import assert_same, connect

SPACES = " \t\n\x0b\x0c\r"


def brute(rows: list[tuple], least: int = 10) -> list[tuple]:
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))
    low = -(1 << 63)
    holders: dict[str, set] = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(low if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        drop = lambda line: len(k := key(line)) >= least and len(holders[k]) > 1 and (low if i is None else i) > min(holders[k])  # noqa: B023, E731
        kept = [x for x in lines if not drop(x)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_like_loops(spark, seed):
    rnd = random.Random(seed)
    pool = [f"Line number {i} of the pool" for i in range(30)] + ["short", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", "ééééé", "", "   ", " nine chr"]
    rows = []
    for i in range(80):
        lines = [rnd.choice(["", " ", "\t"]) + rnd.choice([str.upper, str])(rnd.choice(pool)) + rnd.choice(["", "\r", " "]) for _ in range(rnd.randint(0, 8))]
        rows.append((i, "\n".join(lines + ["a line that all of them hold"] * rnd.randint(0, 2))))
    rows += [(500, None), (501, ""), (3, rows[3][1]), (7, "another text of document seven\nshort"), (None, "a line that all of them hold")]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, pos int")
    assert sorted(map(tuple, linededup.digest(docs).collect()), key=repr) == brute(rows)
    left = {(r.doc_id, r.pos) for r in linededup.dedup(docs).collect()}
    assert left == {(a, 1) for a, _ in rows}


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a line of both", 1, 2, 3), (2, "a line of both\nown", 4, 5, 6)], "doc_id long, text string, _ld_doc int, positions int, r int")
    left = linededup.dedup(docs)
    assert left.schema == docs.schema and sorted(map(tuple, left.collect())) == [(1, "a line of both", 1, 2, 3), (2, "own", 4, 5, 6)]


def test_empty(spark):
    assert linededup.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("query,sql", [(linededup.query, linededup.ORACLE), (quality.query, quality.ORACLE)])
def test_like_sql(spark, query, sql):
    sf = "/root/testdata/sf0.001"
    assert_same(query(spark, sf), connect(sf), sql)


def test_a_task_holds_few_rows_at_a_time():
    """A batch of 10,000 rows is taken in pieces, in order and without loss."""
    batch = pa.record_batch([pa.array(range(10_000))], ["doc"])
    pieces = list(linededup._pieces(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in pieces) == linededup.ROWS
    assert [x for p in pieces for x in p.column("doc").to_pylist()] == list(range(10_000))
