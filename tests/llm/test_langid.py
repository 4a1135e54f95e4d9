"""Language ID: codewords, defined results and held-out accuracy."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from carefold.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 9])
def test_codewords_are_far_apart(n):
    code = langid.codewords(n)
    assert (abs(code.sum(axis=0)) < n).all()
    apart = (code[:, None, :] != code[None, :, :]).sum(axis=2) + code.shape[1] * np.eye(n)
    assert apart.min() >= 2 ** (n - 2) if n <= 5 else apart.min() >= 10


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.query(spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id").filter("held_out AND lang IS NOT NULL AND text IS NOT NULL")
    share = out.filter("lang_pred <> 'und'").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert share >= 0.95


def plain_grams(text: str) -> list[int]:
    """Buckets of the 1- to 3-grams of letters, one by one."""
    m32 = (1 << 32) - 1
    c = [0]
    for ch in text.lower():
        if regex.match(r"\p{L}", ch):
            c.append(ord(ch))
        elif c[-1]:
            c.append(0)
    c.append(0)
    if not any(c):
        return []
    # The first character counts as following a letter, so leading others add a space.
    if not regex.match(r"\p{L}", text.lower()[0]):
        c.insert(0, 0)
    pair = lambda a, b: (a * 0x9E3779B1 + b * 0x85EBCA77) & m32
    out = [x * 0x165667B1 & m32 for x in c if x]
    out += [(pair(a, b) + 1) & m32 for a, b in zip(c, c[1:], strict=False)]
    out += [(pair(a, b) * 0xC2B2AE3D + d * 0x27D4EB2F + 2) & m32 for a, b, d in zip(c, c[1:], c[2:], strict=False)]
    return [((x ^ x >> 15) * 0x2C1B3C6D & m32) >> 19 for x in out]


def test_query_like_plain_python(spark):
    """Every row's language and score, with counts in dictionaries and losses added up bit by bit."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    counts: dict[str, Counter] = {}
    for d in docs:
        if d.lang is not None and d.text is not None and not held(d.doc_id):
            counts.setdefault(d.lang, Counter()).update(plain_grams(d.text))
    names = sorted(counts)
    size, code = langid.BUCKETS, langid.codewords(len(names))
    total = {n: sum(counts[n].values()) + langid.SMOOTHING * size for n in names}
    share = {n: [(counts[n][b] + langid.SMOOTHING) / total[n] for b in range(size)] for n in names}
    bits = []
    for k in range(code.shape[1]):
        side = {s: [n for n, row in zip(names, code, strict=True) if row[k] == s] for s in (1, -1)}
        plus, minus = ([sum(share[n][b] for n in side[s]) / len(side[s]) for b in range(size)] for s in (1, -1))
        weight = [math.log(p) - math.log(m) for p, m in zip(plus, minus, strict=True)]
        high, low = (sum(x * w for x, w in zip(side_, weight, strict=True)) for side_ in (plus, minus))
        bits.append((weight, (high + low) / 2, (high - low) / 2))
    trust = [2 * half * len(bits) / sum(2 * h for _, _, h in bits) for _, _, half in bits]
    got = {r.doc_id: r for r in langid.query(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r, found = got[d.doc_id], plain_grams(d.text or "")
        assert r.held_out == held(d.doc_id)
        if not found:
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, True)
            continue
        loss = []
        for row in code:
            margins = [(sum(w[b] for b in found) / len(found) - centre) / half for w, centre, half in bits]
            loss.append(sum(t * math.log1p(math.exp(-langid.STEEPNESS * s * m)) for t, s, m in zip(trust, row, margins, strict=True)))
        odds = [math.exp(min(loss) - x) for x in loss]
        scores = [o / sum(odds) for o in odds]
        assert abs(scores[names.index(r.lang_pred)] - max(scores)) < 1e-3 and abs(r.score - max(scores)) < 1e-3


def test_defined_results(spark):
    rows = [(1, "the house and the garden of the people", "en"), (3, "das Haus und der Garten der Leute", "de"), (4, "la casa y el jardin de la gente", "es")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == ["de", "en", "es"]
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "123 !?", 5), (4, "the people", 5), (4, "the people", 5), (None, "das und der", 5)], "doc_id long, text string, lang_score int")
    got = [tuple(r) for r in langid.predict(odd, model).select("doc_id", "lang_pred", "lang_score").collect()]
    assert sorted(got[:3]) == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert got[3][1] == got[4][1] == "en" and got[5][1] == "de"
    assert all(0 <= s <= 1 for _, _, s in got)


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.train(none)
    assert model.predict("some text") == ("und", 0.0, True)
    assert langid.predict(none, model).collect() == []
    one = langid.train(spark.createDataFrame([(1, "ein Text", "de")], "doc_id long, text string, lang string"))
    assert one.predict("some text")[0] == "de"


def test_near_ties_are_flagged():
    code = langid.codewords(2)
    model = langid.Model(["a", "b"], code, np.zeros((langid.BUCKETS, 1), np.float32), np.zeros(1), np.ones(1), np.ones(1))
    assert model.predict("anything") == ("a", 0.5, True)


def test_columns_of_any_name(spark):
    """The pipeline's stage gives back whatever columns its input has, as they were."""
    import corpus_pipeline

    rows = [(i, "der die und das ist nicht mit auf" if i % 2 else "the of and to in that it was", "de" if i % 2 else "en", f"own {i}", 0.5, True, i, "t") for i in range(12)]
    rows.append((99, "12 34", None, "x", 0.5, False, 3, "t"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, lang_score double, lang_ambiguous boolean, `a.b` int, r string")
    left = corpus_pipeline.identify_language(spark, docs, "")
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == sorted(rows[:-1])
