"""Conversation repair against a search over all edits, and its matrices and halves against row by row."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from carefold.llm import dialogs

sys.setrecursionlimit(20_000)  # for the search over all edits

SCHEMA = "conv_id long, turn long, role string, text string, n string, td int"


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, audit) for rows (initial, fault), the least of all scripts by recursion over rows and the last initial."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i: int, last: str, inserted: int) -> tuple[int, str]:
        found = [(0, "")] if i == len(rows) and last in ("", "a") else []
        if inserted < 4:
            for new in "ua":
                if new in follows[last]:
                    cost, rest = best(i, new, inserted + 1)
                    found.append((cost + 3, "I" + rest))
        if i < len(rows):
            initial, fault = rows[i]
            cost, rest = best(i + 1, last, 0)
            found.append((cost + 4, "D" + rest))
            if fault not in ("blank", "duplicate"):
                for letter, price, new in [("K", 0, initial), ("R", 3, "u"), ("R", 3, "a")]:
                    if new and new in follows[last]:
                        cost, rest = best(i + 1, new, 0)
                        found.append((cost + price + 3 * (fault == "truncated"), letter + rest))
        return min(found, default=(1 << 50, ""))

    return best(0, "", 0)


def expected(table: list[tuple]) -> list[tuple]:
    """op13's rows by loops over whole conversations."""
    out = []
    said = lambda x: " " if x is None else str(x)
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            how = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
            text = "" if how == 1 else re.sub("[.!?]", "", said(text)) if how == 2 else said(text)
            rows += [(turn, "user" if how == 4 else said(role), text)] * (0 if how == 0 else 2 if how == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit = cheapest([(r[:1], f) for (_, r, _), f in zip(rows, faults, strict=True)])
        lines, left, last = [], iter(rows), ""
        for letter in audit:
            new = "assistant" if last == "u" else "user"
            if letter == "I":
                lines.append(f"{new}:")
            else:
                _, role, text = next(left)
                if letter == "D":
                    continue
                lines.append(f"{new if letter == 'R' else role}:{text}")
            last = lines[-1][0]
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


_ROW = st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.sampled_from(["", "", "truncated", "blank"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(_ROW, st.integers(1, 9)), max_size=9))
def test_runs_like_all_edits(runs):
    rows = [row for row, n in runs for _ in range(n)]
    one = dialogs.Dialog()
    for initial, fault in rows:
        one.add(dialogs.GONE if fault == "blank" else dialogs.symbol(initial, fault == "truncated"), 1)
    assert one.solve() == cheapest(rows)


def test_many_runs(monkeypatch):
    """Kept costs are made again from the nearest ones."""
    rnd = random.Random(2)
    rows = [(rnd.choice("sua"), rnd.choice(["", "truncated", "blank"])) for _ in range(200)]
    monkeypatch.setattr(dialogs, "KEPT", 7)
    one = dialogs.Dialog()
    for initial, fault in rows:
        one.add(dialogs.GONE if fault == "blank" else dialogs.symbol(initial, fault == "truncated"), 1)
    assert one.solve() == cheapest(rows)


def test_long_run():
    """A run of a million rows takes its powers, not its rows, to be advanced."""
    one = dialogs.Dialog()
    one.add(dialogs.symbol("user", False), 1_000_000)
    assert dialogs.back(one.syms[0], 1_000_000, (0, 6, 3, 0))[0] == 3 * 1_000_000 // 2
    one.add(dialogs.symbol("user", False), 1_000)
    one.lengths[0] = 1_001
    cost, audit = one.solve()
    assert cost == 500 * 3 + 3 and audit.count("I") + audit.count("R") == 501


def made(seed: int, convs: int, long: int) -> list[tuple]:
    rnd = random.Random(seed)
    texts = ["Yes.", "Yes.", "No!", "Why?", "so on", "a. ", "ok \n", "", " ", "\t\n", None, "é?", "1.5", "the end" * 50]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "User", "agent", "tool"]
    rows = [(c, t if rnd.random() < 0.9 else None, rnd.choice(roles), rnd.choice(texts)) for c in range(convs) for t in range(rnd.randrange(1, 9))]
    rows += [(c, t * 3, "user" if t % 2 == 0 else "assistant", f"Text {c} {t}.") for c in range(50, 60) for t in range(6)]
    rows += [(None, t, rnd.choice(roles), rnd.choice(texts)) for t in range(5)] + rows[:7]
    return rows + [(999, t, rnd.choice(roles[:3]), rnd.choice([f"Words {t}.", f"Words {t}", "again."])) for t in range(long)]


@pytest.mark.parametrize("seed", [1, 2])
def test_query(spark, tmp_path, seed):
    rows = made(seed, 40, 300)
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, dialogs.query(spark, str(tmp_path)).collect()), key=repr)
    assert got == expected(rows)


def test_repaired_rows(spark):
    rows = made(3, 30, 120)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    told, repaired = dialogs.repair(dialogs.damaged(table))
    told = {r.conv_id: r for r in told.collect()}
    by: dict = {}
    for r in sorted(repaired.collect(), key=lambda r: r.place):
        by.setdefault(r.conv_id, []).append(r)
    for conv, *_, audit, digest in expected(rows):
        own = by.get(conv, [])
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == digest
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own)) and "".join(r.edit for r in own) == audit.replace("D", "")
        assert told[conv].audit == audit and [r.place for r in own] == list(range(len(own)))


def test_everything_dropped(spark, tmp_path):
    turns = [t for t in range(200) if zlib.crc32(f"5:{t}".encode()) % 20 == 0][:3]
    assert turns
    spark.createDataFrame([(5, t, "user", "Hi.", "x", 1) for t in turns], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in dialogs.query(spark, str(tmp_path)).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert dialogs.query(spark, str(tmp_path)).collect() == []
