"""Stored tables: merges in turn, what they leave untouched, failures, other writers, older versions."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from carefold.operators import store
from carefold.operators.store import Conflict, KeyedTable
from carefold.storage import shared_dir

SCHEMA = "k long, v string, n int"


@pytest.fixture
def table(spark):
    return KeyedTable.create(spark, shared_dir(spark, "keyed"), SCHEMA, "k", 8)


def rows(spark, *given):
    return spark.createDataFrame(list(given), SCHEMA)


def held(table, version=None):
    return {r.k: (r.v, r.n) for r in table.read(version).collect()}


def files(table) -> dict[str, float]:
    root = Path(table.path.removeprefix("file://"))
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_merges_in_turn(spark, table):
    assert table.merge(rows(spark, *[(i, f"a{i}", i) for i in range(100)])) == 1
    before = files(table)
    assert table.merge(rows(spark, (3, "b", None), (200, "new", 1)), deleted=spark.createDataFrame([(7,), (3000,)], "k long")) == 2
    want = {i: (f"a{i}", i) for i in range(100) if i != 7} | {3: ("b", None), 200: ("new", 1)}
    assert held(table) == want
    # Files of the version before are as they were, and those of the buckets without changes serve the new one.
    after = files(table)
    assert all(after[f] == t for f, t in before.items())
    old, new = table.manifest(1)["files"], table.manifest(2)["files"]
    touched = {b for b in new if new[b] != old.get(b)}
    assert 0 < len(touched) <= 4 and len(old) == 8 and all(new[b] == old[b] for b in old if b not in touched)
    assert held(table, 1) == {i: (f"a{i}", i) for i in range(100)} and held(table, 0) == {}
    assert [r.v for r in table.lookup(spark.createDataFrame([(3,), (7,)], "k long")).orderBy("k").collect()] == ["b", None]


def test_new_keys_leave_files_as_they_are(spark, table, monkeypatch):
    """Rows of new keys are put beside the others; a bucket is written anew for a known key, or of too many files."""
    monkeypatch.setattr(store, "MAX_FILES", 2)
    names = []
    for i in range(4):
        table.merge(rows(spark, *[(k, f"v{i}", i) for k in range(100 * i, 100 * i + 100)]))
        names.append(table.manifest()["files"])
    assert all(len(new) == len(old) + 1 and new[: len(old)] == old for a, b in zip(names[:2], names[1:3], strict=True) for old, new in ((a[x], b[x]) for x in a))
    assert {len(x) for x in names[3].values()} == {1}
    assert held(table) == {k: (f"v{k // 100}", k // 100) for k in range(400)}
    table.merge(rows(spark, (5, "other", 9)), deleted=spark.createDataFrame([(1000,)], "k long"))
    assert sum(table.manifest()["files"][x] != names[3][x] for x in names[3]) == 1 and held(table)[5] == ("other", 9) and len(held(table)) == 400


def test_like_a_dictionary(spark, table):
    rnd, want = random.Random(5), {}
    for _ in range(4):
        changes = [(rnd.choice([None, *range(30)]), rnd.choice("xyz"), rnd.randrange(99)) for _ in range(25)]
        gone = [rnd.choice([None, *range(40)]) for _ in range(5)]
        table.merge(rows(spark, *changes).withColumn("extra", F.lit(1)), spark.createDataFrame([(k,) for k in gone], "k long"), order=F.col("n"))
        for k, v, n in sorted(changes, key=lambda r: (r[2], r[1])):
            want[k] = (v, n)
        for k in gone:
            want.pop(k, None)
        assert held(table) == want


def test_without_rows_and_columns(spark, table):
    assert table.merge(rows(spark)) == 0 and held(table) == {}
    table.merge(spark.createDataFrame([(1,), (None,)], "k int"))
    assert held(table) == {1: (None, None), None: (None, None)}
    assert table.merge(rows(spark), deleted=spark.createDataFrame([(1,), (None,)], "k long")) == 2 and held(table) == {}


def test_a_failed_merge_leaves_the_version_before(spark, table):
    table.merge(rows(spark, (1, "a", 1)))
    broken = rows(spark, (1, "b", 2), (2, "c", 3)).withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no"):
        table.merge(broken)
    assert table.versions() == [0, 1] and held(table) == {1: ("a", 1)}
    # Files that were written but never published do not show.
    rows(spark, (9, "z", 9)).withColumn("_bucket", F.lit(1)).write.partitionBy("_bucket").parquet(f"{table.path}/data/lost")
    assert held(table) == {1: ("a", 1)}


def test_of_two_writers_the_second_fails(spark, table, monkeypatch):
    other = KeyedTable(spark, table.path)
    seen = other.manifest()
    table.merge(rows(spark, (1, "first", 1)))
    monkeypatch.setattr(other, "manifest", lambda version=None: seen)
    with pytest.raises(Conflict):
        other.merge(rows(spark, (1, "second", 2)))
    assert held(table) == {1: ("first", 1)} and table.versions() == [0, 1]


def test_vacuum(spark, table):
    for i in range(3):
        table.merge(rows(spark, (i, "a", i), (0, "b", i)))
    want, n = held(table), len(files(table))
    assert table.vacuum() == n - len(files(table)) and table.versions() == [3]
    assert held(table) == want and len(files(table)) == sum(map(len, table.manifest()["files"].values()))
