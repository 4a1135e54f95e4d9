"""Verdicts over stretches of keys against a loop over each key's statements."""

from __future__ import annotations

import datetime
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from carefold.operators import ledger, verdicts

SCHEMA = "id long, patient_id long, subject string, value string, valid_from date, extra string"


def by_loop(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """((id, verdict, target), (id, valid_to, superseded_by, contested, restated)) for (patient, subject, day, id, value)."""
    said, facts, key, active = [], {}, None, None
    for row in sorted(rows, key=lambda r: r[:4]):
        if row[:2] != key:
            key, active = row[:2], None
        kind = ledger.verdict(active and (active[3], active[4], active[2]), row[4], row[2])
        said.append((row[3], kind, active and active[3]))
        if kind == ledger.CONSISTENT:
            facts[active[3]][3] += 1
            continue
        facts[row[3]] = [None, None, False, 0]
        if kind == ledger.SUPERSEDES:
            facts[active[3]][:2] = [row[2], row[3]]
        if kind == ledger.CONTRADICTS:
            facts[active[3]][2] = facts[row[3]][2] = True
        active = None if kind == ledger.CONTRADICTS else row
    return said, [(i, *f) for i, f in facts.items()]


def day(n: int) -> datetime.date:
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.date32(), pa.int64(), pa.string())
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], verdicts.COLUMNS)


_STATEMENT = st.tuples(st.integers(1, 2), st.sampled_from("st"), st.integers(0, 2), st.sampled_from("abc"))


@settings(max_examples=500, deadline=None)
@given(st.lists(_STATEMENT, max_size=24), st.lists(st.integers(0, 24), max_size=4), st.lists(st.integers(0, 24), max_size=4))
def test_any_cut(statements, tasks, batches):
    """Rows cut into tasks and batches anywhere give what one loop gives."""
    rows = sorted((p, s, day(d), i, v) for i, (p, s, d, v) in enumerate(statements))
    said, facts = by_loop(rows)
    cuts = sorted({0, len(rows), *(c for c in tasks if c < len(rows))})
    parts = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        inner = sorted({a, b, *(c for c in batches if a < c < b)})
        parts.append([batch(rows[x:y]) for x, y in zip(inner, inner[1:], strict=False)])
    known = verdicts.put_together({i: verdicts.describe(iter(p)) for i, p in enumerate(parts)})
    got, made = [], {}
    for i, part in enumerate(parts):
        scan = None
        for one in part:
            scan = scan or verdicts._begun(one, known[i][0])
            every, kind, about, closed = scan.feed(one)
            ids = every.column("id").to_pylist()
            got += [(ids[j], verdicts.KINDS[kind[j]], None if about[j] < 0 else ids[about[j]]) for j in range(scan.before, len(ids))]
            made |= {ids[j]: int(scan.n[j]) for j in closed}
        if scan.active is not None and not scan.foreign:
            more, by, contradicted = known[i][1]
            made[scan.active.column("id")[0].as_py()] = scan.restated + more
            of = next(f for f in facts if f[0] == scan.active.column("id")[0].as_py())
            assert of[1:4] == ((by[2], by[3], False) if by and not contradicted else (None, None, bool(contradicted)))
    assert got == said
    assert made == {f[0]: f[4] for f in facts}


@pytest.mark.parametrize("seed", [1, 2])
def test_spread_over_tasks(spark, request, seed):
    """A key with most of all rows goes to several tasks and is judged as a whole."""
    rnd = random.Random(seed)
    rows, value = [], "a"
    for i in range(4000):
        value = value if rnd.random() < 0.7 else rnd.choice("abc")
        rows.append((7, "hot", day(i // rnd.choice([1, 3, 50])), i, value))
    rows += [(rnd.randrange(40), "s", day(rnd.randrange(9)), 5000 + i, rnd.choice("ab")) for i in range(2000)]
    given_ = [(i, p, s, v, d, "x") for p, s, d, i, v in rows] + [(1, None, "s", "a", day(1), "x"), (2, 1, "s", None, day(1), "x")]
    rnd.shuffle(given_)
    statements = spark.createDataFrame(given_, SCHEMA).repartition(5)
    said, facts = by_loop(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one partition
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    assert sorted((r.id, r.classification, r.target) for r in verdicts.classify(statements).collect()) == sorted(said)
    found = verdicts.facts(statements)
    assert sorted(((r.id, r.valid_to, r.superseded_by, r.contested, r.restated) for r in found.collect()), key=lambda r: r[0]) == sorted(facts, key=lambda r: r[0])
    parts, _ = verdicts._ordered(statements)
    sizes = [n for n in parts.rdd.glom().map(len).collect() if n]
    assert len(sizes) > 2 and max(sizes) < len(rows) / 2


def test_nothing_said(spark):
    assert verdicts.classify(spark.createDataFrame([], SCHEMA)).collect() == [] and verdicts.facts(spark.createDataFrame([], SCHEMA)).collect() == []
