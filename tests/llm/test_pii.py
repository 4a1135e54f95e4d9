"""Personal data: base spans against Python's regular expressions, the models, and the spans that are added."""

from __future__ import annotations

import hashlib
import math
import re

import pytest
import regex

from carefold.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind: str, m: str) -> bool:
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    return True


def base(text: str | None) -> list[tuple[str, int, int]]:
    return [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(PATTERNS[k], text or "") if valid(k, m[0])]


TEXTS = [
    None,
    "",
    "nobody here",
    "mail a.b+c@x-y.org, x@y, @z.com a@b.c.d. and a@b..c e%f@g.h@i.j k@l.m-",
    "1.2.3.4 256.1.1.1 01.002.3.255 1.2.3.4.5.6.7.8 1.2.3 a1.2.3.4b 10.0.0.1.",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 5500-0000-0000-0004x 41111111111111111111 1 2 3",
    "call +1 (555) 123-4567 or +49 30 1234567, +12, +1-2-3-4-5-6-7-8, +123456789012345678, ++1 5551234567 (555) 123-4567 555-123-4567",
    "é🙂 x@y.org 🙂 8.8.8.8 é +44 20 7946 0958",
    "1" * 3000 + " " + "a" * 3000 + "@" + "b.c" * 500,
    "a@b.c@d.e@f.g", "1.1.1.1.2.2.2.2", "++11 2345678 9", "4111 1111 1111 1111 4111 1111 1111 1111",
]


def of_query(spark, rows, tmp_path):
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kind string, row int").write.parquet(f"{tmp_path}/documents.parquet")
    return pii.query(spark, str(tmp_path)).collect()


def test_base_spans(spark, tmp_path):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, TEXTS[5])]
    got = of_query(spark, rows, tmp_path)
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        found = base(t)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
        want[i] = (*[sum(k == x for x, _, _ in found) for k in pii.KINDS], hashlib.sha256(joined.encode()).hexdigest(), set(joined.split(",")) - {""})
    for r in got:
        assert tuple(r)[1:6] == want[r.doc_id][:5]
        assert want[r.doc_id][5] <= set(r.spans.split(","))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.query(spark, sf).collect():
        found = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()
        every = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert every == sorted(every, key=lambda x: (pii.KINDS.index(x[0]), int(x[1])))


def test_reliable_labelers_win():
    # Labeler 1 agrees with most of the others, labeler 4 votes at random.
    counts = {"+++++": 400, "++++-": 400, "-----": 500, "----+": 500, "+-0++": 5}
    truth, model = pii.reliabilities(counts)
    assert truth["++++-"] > 0.9 and truth["----+"] < 0.1
    assert abs(model[4]["+"][1] - model[4]["+"][0]) < abs(model[0]["+"][1] - model[0]["+"][0])


LOOSE_TEXTS = [
    "write to ann.lee at example dot org or bob[at]mail[dot]example[dot]com", "contact: kim (at) example (dot) net", "we met at noon dot dot",
    "host 2001:0db8:0000:0000:0000:ff00:0042:8329 and fe80:1:2:3:4:5:6:7, time 12:30:45", "a:b:c:d:e:f:1:2:3", "login ip 2001:1:2:3:4:5:6:7x",
    "credit card 4111 1111 1111 1112 and tel (555) 123-4567", "555.123.4567 is no call", "visa 4111.1111.1111.1111",
]


def plain_spans(texts: list[str | None]) -> tuple[list[list[tuple]], set]:
    """All spans of each text, and those that the method added, in plain Python."""
    rows = []
    for i, t in enumerate(texts):
        text = t or ""
        found = [(k, False, PATTERNS[k]) for k in pii.KINDS] + [(k, True, pii.LOOSE[k]) for k in pii.LOOSE]
        for kind, loose, pattern in found:
            matches = list(regex.finditer(pattern, text))
            for j, m in enumerate(matches):
                before = text[matches[j - 1].end() if j else 0 : m.start()][-40:]
                after = text[m.end() : matches[j + 1].start() if j + 1 < len(matches) else len(text)][:1]
                based = not loose and valid(kind, m[0])
                digits = re.sub("[^0-9]", "", m[0])
                glue = r"[A-Za-z0-9_\"/=]"
                sign = lambda yes: "+" if yes else "-"
                votes = sign(based) + sign(regex.search(pii.SHAPE[kind], m[0])) + sign(regex.search(pii.KNOWN[kind], m[0].lower()))
                votes += "+" if regex.search(pii.CUES[kind], before) else "0"
                votes += "-" if re.search(glue, before[-1:]) or re.search(glue, after) else "0"
                value = {"length": min(len(m[0]), 40), "digits": min(len(digits), 20), "distinct": len(set(digits)) or 1, "luhn": str(luhn(digits)).lower(), "breaks": min(len(re.sub("[A-Za-z0-9]", "", m[0])), 8)}
                rows.append((i, kind, m.start(), m.end(), based, votes, [kind] + [f"{kind} {n} {v}" for n, v in value.items()]))
    # Expectation-maximisation over candidates, one by one.
    truth = [min(0.9, max(0.1, 0.5 + 0.2 * (r[5].count("+") - r[5].count("-")))) for r in rows]
    for _ in range(pii.EM_ROUNDS):
        yes, no = sum(truth), sum(1 - x for x in truth)
        table = [{v: ((sum(1 - x for x, r in zip(truth, rows, strict=True) if r[5][k] == v) + 1) / (no + 3), (sum(x for x, r in zip(truth, rows, strict=True) if r[5][k] == v) + 1) / (yes + 3)) for v in "+-0"} for k in range(5)]
        odds = [math.log((yes + 1) / (no + 1)) + sum(math.log(table[k][v][1] / table[k][v][0]) for k, v in enumerate(r[5])) for r in rows]
        truth = [1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for o in odds]
    yes, no = sum(truth), sum(1 - x for x in truth)
    prior = math.log((yes + 0.5) / (no + 0.5))
    weight = {}
    for f in {f for r in rows for f in r[6]}:
        y, n = (sum(w for x, r in zip(truth, rows, strict=True) if f in r[6] for w in [x if good else 1 - x]) for good in (True, False))
        weight[f] = math.log((y + 0.5) / (yes + 1)) - math.log((n + 0.5) / (no + 1))
    every, added = [], set()
    for i in range(len(texts)):
        own = {(pii.KINDS.index(r[1]), r[2], r[3]) for r in rows if r[0] == i and r[4]}
        for r in rows:
            span = (pii.KINDS.index(r[1]), r[2], r[3])
            score = prior + sum(weight[f] for f in r[6])
            if r[0] == i and not r[4] and score >= math.log(pii.SURE / (1 - pii.SURE)) and r[5].count("+") >= r[5].count("-"):
                if not any(b[1] < r[3] and r[2] < b[2] for b in own):
                    added.add((i, span))
        every.append(sorted(own | {s for j, s in added if j == i}))
    return [[(pii.KINDS[k], s, e) for k, s, e in spans] for spans in every], added


def test_added_spans_like_plain_python(spark, tmp_path):
    texts = TEXTS + LOOSE_TEXTS
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    want, added = plain_spans(texts)
    kinds = {k for _, (k, _, _) in added}
    assert len(kinds) >= 2, "too few kinds of spans are added for this to show anything"
    for r in of_query(spark, list(enumerate(texts)), tmp_path):
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in want[r.doc_id]), texts[r.doc_id][:200]


def test_no_documents(spark, tmp_path):
    assert of_query(spark, [], tmp_path) == []


def test_no_python_in_the_plan(spark):
    plan = pii.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
