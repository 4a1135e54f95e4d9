r"""Quality rules (operator 9), by DataFrame functions alone.

Method: a short-circuit cascade. Each rule names the features it needs and the condition under which it rejects a
document. On a sample (of SAMPLE_ROWS rows or so: it only orders the rules and never decides about a row) the share of
rows that each rule rejects is counted, and so are the characters, words and lines of the rows, in one job for all
combinations of verdicts; a rule's cost is the steps (STEPS) that its features take for what was counted, so the order is
the same in every run. Rules are ordered greedily: next comes the one that rejects most per cost of the features it still
needs, both among the rows that the rules before it keep. ``cascade`` and ``verdicts`` compute a rule's features only for the rows that all rules before
it kept, ``verdicts`` but for the features that are wanted of every row. All rules must keep a document, so the order
changes the work and not the verdict.

Everything is computed within the row it belongs to: no shuffle, no Python, and repeated 3-word windows are found by
sorting a row's own window hashes (only where a hash set shows that any window repeats), n log n in its words.

Defined results: null and empty texts have no words and are rejected; rows are independent, so repeated rows, null
doc_ids and ties need no rule; an empty table gives an empty result; ``cascade`` keeps extra columns of any name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carefold.llm._common import table

SPACES = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2_000


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[dict[str, Column]], Column]  # a condition over the features


RULES = (
    Rule("few_words", ("n_words",), lambda f: f["n_words"] < 50),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
    Rule("word_length", ("n_words", "word_chars"), lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 15 * f["n_words"])),
    Rule("symbols", ("n_words", "n_symbols"), lambda f: 2 * f["n_symbols"] > f["n_words"]),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda f: 100 * f["n_dup_lines"] > 30 * f["n_lines"]),
    Rule("capitals", ("word_chars", "n_capitals"), lambda f: 2 * f["n_capitals"] > f["word_chars"]),
)

#: Steps that a feature takes for each character, word and line of a text; windows are as many as words, and are hashed
#: and may be sorted. How many of these there are is counted on the sample.
STEPS = {
    "n_words": (2, 1, 0), "word_chars": (1, 0, 0), "n_symbols": (1, 0, 0), "n_lines": (2, 0, 2), "n_dup_lines": (2, 0, 20), "n_capitals": (3, 0, 0), "n_repeat_words": (3, 60, 0),
}


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once however often (and in however many lambdas) body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(text: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text."""
    words = F.transform(F.regexp_extract_all(text, F.lit(f"[^{SPACES}]+"), F.lit(0)), lambda w: F.xxhash64(w))

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.when(F.size(w) >= 3, F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def repeated(k: Column) -> Column:
        ordered = F.array_sort(F.transform(k, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(k)) < F.size(k), _with(ordered, count))

    def count(s: Column) -> Column:
        same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
        twice = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.coalesce(_with(_with(words, windows), repeated), F.lit(0))


def features() -> dict[str, Column]:
    """The features of column text by name; null counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACES}]"))
    found = {
        "n_words": F.regexp_count(text, F.lit(f"[^{SPACES}]+")),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_lines": F.size(lines),
        "n_dup_lines": _with(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))),
        "n_capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")),
        "n_repeat_words": _repeat_words(text),
    }
    return {name: value.cast("long") for name, value in found.items()}


def with_features(docs: DataFrame, names: set[str]) -> DataFrame:
    """Adds the named features of column text."""
    every = features()
    return docs.withColumns({n: every[n] for n in sorted(names)})


def _columns(names: tuple[str, ...]) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, free: tuple[str, ...] = ()) -> list[tuple[Rule, float, float]]:
    """(rule, steps for a row, share rejected), of the rows that the rules before it keep, in the order of the cascade.

    ``free`` features are computed anyway and cost nothing. Ties go to the rule that is named first.
    """
    total = docs.count()
    sample = docs.select("text").sample(min(1.0, rows / max(total, 1)), seed=1)
    judged = with_features(sample, {"n_words", "n_lines", *(n for rule in rules for n in rule.needs)})
    judged = judged.withColumn("n_chars", F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    verdict = F.concat(*[F.when(rule.rejects(_columns(rule.needs)), "1").otherwise("0") for rule in rules])
    counted = judged.groupBy(verdict.alias("v")).agg(F.count("*"), *[F.sum(c) for c in ("n_chars", "n_words", "n_lines")])
    seen = [(r[0], r[1], r[2:]) for r in counted.collect()]  # at most 2 ** rules rows
    size = max(1, sum(n for _, n, _ in seen))
    out, have, left = [], set(free), list(range(len(rules)))
    while left:
        alive = max(1, sum(n for _, n, _ in seen))
        share = {i: sum(n for v, n, _ in seen if v[i] == "1") / alive for i in left}
        each = [sum(units[u] for _, _, units in seen) / alive for u in range(3)]
        steps = {f: sum(a * b for a, b in zip(STEPS[f], each, strict=True)) for f in STEPS if f not in have}
        cost = {i: sum(steps[f] for f in rules[i].needs if f in steps) for i in left}
        best = max(left, key=lambda i: ((share[i] + 1 / size) / (cost[i] + 1), -i))  # noqa: B023
        out.append((rules[best], cost[best], share[best]))
        seen = [x for x in seen if x[0][best] == "0"]
        have |= set(rules[best].needs)
        left.remove(best)
    return out


def cascade(docs: DataFrame, ordered: list[Rule]) -> DataFrame:
    """The rows of ``docs``, all columns, that every rule keeps; a rule sees only what those before it kept."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("r"), "text")
    for rule in ordered:
        rows = with_features(rows, set(rule.needs)).filter(~rule.rejects(_columns(rule.needs)))
    return rows.select("r.*")


def verdicts(docs: DataFrame, ordered: list[Rule], wanted: tuple[str, ...]) -> DataFrame:
    """doc_id, the ``wanted`` features and kept.

    Other features are computed within the row only where the rules before have kept it: Spark evaluates a condition's
    branches one after the other.
    """
    every = features()
    out = docs.select("doc_id", "text").withColumns({n: every[n] for n in wanted})
    kept = F.lit(True)
    for rule in reversed(ordered):
        kept = F.when(rule.rejects({n: F.col(n) if n in wanted else every[n] for n in rule.needs}), False).otherwise(kept)
    return out.withColumn("kept", kept).drop("text")


#: What the query returns of every document.
WANTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = verdicts(docs, [rule for rule, _, _ in estimate(docs, free=WANTED)], WANTED)
    base_failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return judged.select("doc_id", *WANTED, base_failed.alias("base_failed"), "kept")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM t WHERE len(w) >= 3),
k AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY doc_id),
f AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS BIGINT) AS n_capitals,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 2 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines OR 2 * n_capitals > word_chars) AS kept
FROM f
"""
