"""Quality rules: features against Python, and the cascade's order."""

from __future__ import annotations

import random
import re

from carefold.llm import quality


def features(text: str | None) -> tuple:
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {k for at in windows.values() if len(at) > 1 for i in at for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)


def test_features(spark, tmp_path):
    rnd = random.Random(4)
    texts = [None, "", " \n", "a b", "a a a a", "a b c a b c", "x\nx\n\n\nx \nx", "#*$ %&|<> é🙂", "word " * 5000, "\x0ba\x0cb\x1cc\x85d e"]
    texts += [" ".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 120))) for _ in range(40)]
    texts += ["\n".join(rnd.choice(["one line of words", "Another Line", "THIRD"]) for _ in range(30)), "plain words of some length that differ " + " ".join(f"w{i}x" for i in range(60))]
    rows = list(enumerate(texts)) + [(4, texts[4]), (None, texts[-1])]
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in quality.query(spark, str(tmp_path)).collect()}
    for i, t in rows:
        want = features(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)
    assert got[len(texts) - 1].kept and got[None].kept


def test_cascade_is_the_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ordered = [r for r, _, _ in quality.estimate(docs)]
    assert sorted(r.name for r in ordered) == sorted(r.name for r in quality.RULES)
    assert ordered == [r for r, _, _ in quality.estimate(docs)]  # the same in every run
    for order in (ordered, ordered[::-1]):
        kept = {r.doc_id for r in quality.verdicts(docs, order, quality.WANTED).filter("kept").collect()}
        assert {r.doc_id for r in quality.cascade(docs, order).collect()} == kept and kept


def test_order_by_rejection_per_cost(spark):
    """What rejects nothing comes last; shares are of what earlier rules keep."""
    docs = spark.createDataFrame([(1, "a b c")] * 10 + [(2, "# # # #" * 3 + " word" * 80)] * 5, "doc_id long, text string")
    found = [(r.name, share) for r, _, share in quality.estimate(docs)]
    assert found[0] == ("few_words", 10 / 15) and dict(found)["capitals"] == 0
    assert dict(found)["repeated_words"] in (0.0, 1.0)


def test_cascade_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(60)), 7, 8)], "doc_id long, text string, n_words int, r int")
    left = quality.cascade(docs, list(quality.RULES))
    assert left.columns == docs.columns and [tuple(r)[2:] for r in left.collect()] == [(7, 8)]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.verdicts(none, [r for r, _, _ in quality.estimate(none)], quality.WANTED).collect() == []


def test_costs_are_counted_on_the_sample(spark):
    """Steps of a row follow the characters, words and lines of the rows that are left; what is free costs nothing."""
    text = "alpha beta gamma delta"
    docs = spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string")
    cost = {r.name: c for r, c, _ in quality.estimate(docs, quality.RULES[1:2])}
    assert cost == {"repeated_words": (2 + 3) * len(text) + (1 + 60) * 4}
    assert [c for _, c, _ in quality.estimate(docs, quality.RULES[1:2], free=("n_words", "n_repeat_words"))] == [0]
    # The same rule is dear where lines are many.
    lines = spark.createDataFrame([(i, "\n".join(text.split())) for i in range(20)], "doc_id long, text string")
    rule = quality.RULES[4:5]
    assert quality.estimate(lines, rule)[0][1] - quality.estimate(docs, rule)[0][1] == 3 * (2 + 20)
