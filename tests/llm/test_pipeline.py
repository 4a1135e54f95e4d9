"""The corpus pipeline, stage by stage, against plain Python."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

import corpus_pipeline
from carefold.llm import decontam
from tests.llm.test_decontam import slow_tiles
from tests.llm.test_linededup import SPACES
from tests.llm.test_nearcopies import kept

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> tuple[list[tuple], list[str]]:
    rnd = random.Random(11)
    pools = {"en": "the of and to in that it was for on are with", "de": "der die und das ist nicht mit auf für wird"}
    items = [" ".join(f"item{i}word{k}" for k in range(30)) for i in range(3)]
    rows = []
    for i in range(70):
        lang = rnd.choice(list(pools))
        words = pools[lang].split()
        line = lambda: " ".join(rnd.choice(words) + rnd.choice(["", "a", "er", "st", "um"]) for _ in range(rnd.randint(5, 25)))  # noqa: B023, E731
        lines = [line() for _ in range(rnd.randint(1, 5))]
        if i % 5 == 0:
            lines.insert(rnd.randint(0, len(lines)), "  This very line is on MANY pages ")
        if i % 9 == 0:
            passage = rnd.choice(items).split()
            cut = rnd.randint(8, 22)
            lines.append(" ".join(passage[cut:] + ["between"] + passage[:cut]))
        if i % 7 == 3:  # copies but for the line ends, so that line dedup leaves them alone
            lines = [rows[-1][1].replace("\n", " ") + " end"]
        rows.append((i * 7 % 71, "\n".join(lines), lang))
    rows += [(100, None, "en"), (101, "", None), (102, "12 34 -- 56", "de"), (103, "this very line is on many pages", "en"), (104, "ok", None), (105, "this very line is on many pages\n\t\n ", "en")]
    return [(i, t, lang, "web", len(t or "")) for i, t, lang in rows], items


def without_repeated_lines(rows: list[tuple]) -> list[tuple]:
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(SPACES))
    first: dict[str, int] = {}
    for i, t, *_ in rows:
        for x in t.split("\n"):
            first[key(x)] = min(i, first.get(key(x), i))
    out = []
    for i, t, lang, source, _ in rows:
        left = "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == i)
        if left.strip(SPACES):
            out.append((i, left, lang, source, len(left)))
    return out


def one_of_each(rows: list[tuple]) -> list[tuple]:
    """One of each group at a five-word Jaccard similarity of 0.8 or more, by all pairs."""
    first = set(kept([(r[0], r[1]) for r in rows]))
    return [r for r in rows if r[0] in first]


def without_items(rows: list[tuple], items: list[str]) -> list[tuple]:
    each = [decontam.words_of(x) for x in items]
    return [r for r in rows if all(slow_tiles(decontam.words_of(r[1]), x, decontam.GRAM) < decontam.THRESHOLD * len(x) for x in each)]


def encoded(rows: list[tuple]) -> list[tuple]:
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda data: hashlib.sha256(data).hexdigest()
    out = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t)
        out.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())))
    return sorted(out)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows, items = corpus()
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"file://{at}/benchmark.parquet")
    return at, rows, items


def test_each_stage_and_the_whole(spark, stored):
    at, rows, items = stored
    plain = [
        lambda rows: [r for r in rows if regex.search(r"\p{L}", r[1] or "")],
        without_repeated_lines,
        one_of_each,
        lambda rows: without_items(rows, items),
    ]
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        got = stage(spark, spark.createDataFrame(rows, SCHEMA), at)
        assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")], name
        before, rows = rows, sorted(expected(rows))
        assert sorted(map(tuple, got.collect())) == rows, name
        assert rows != sorted(before, key=repr), f"{name} has nothing to do here"
    assert sorted(map(tuple, corpus_pipeline.run(spark, at).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == encoded(rows)


def test_no_documents(spark, stored, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{stored[0]}/benchmark.parquet").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
