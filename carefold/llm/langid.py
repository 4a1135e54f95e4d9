"""Language ID (operator 3): error-correcting output codes over binary n-gram classifiers.

Method: every language has a codeword of +1/-1 bits. For each bit a linear classifier over hashed character
n-grams separates the languages whose bit is +1 from the others. A text's bits are scored, and the language whose
codeword has the least loss, bits weighted by how well their classifiers separate, is predicted; where the two
nearest codewords are almost as near, the row is flagged as ambiguous.

Training counts the n-grams of all labelled training rows in one pass: each task adds up its own
(language, bucket) table, so what is shuffled and sent to the driver is languages x BUCKETS numbers, whatever the
input. The model (BUCKETS x bits) goes to the executors with the prediction pass, which has no shuffle.

Defined results: null texts and texts without a letter get ``und`` with score 0 and are flagged; an empty table,
or one without labels, gives ``und`` for every row. Ties go to the alphabetically first language. Rows with a
null doc_id are training rows. Rows are independent: repeated rows get equal results. Whole texts are used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carefold.llm._arrays import LETTER, character_classes, code_points
from carefold.llm._common import rows_as, table

BUCKETS = 1 << 13
UNDETERMINED = "und"

#: Pseudo-count of an n-gram bucket.
SMOOTHING = 0.5
#: Steepness of the logistic loss on margins that are +1 or -1 for typical texts.
STEEPNESS = 3.0
#: A row is ambiguous if its score is less than this above the second language's.
AMBIGUOUS = 0.05


def grams(text: str) -> np.ndarray:
    """Hash buckets of the text's 1- to 3-grams of letters; a run of other characters counts as one space."""
    cps = code_points(text.lower())
    letter = character_classes()[cps] == LETTER
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    after = np.concatenate([[True], letter[:-1]])
    c = np.concatenate([[0], np.where(letter, cps, 0)[letter | after], [0]]).astype(np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
    one = c[c > 0] * np.uint32(0x165667B1)
    out = np.concatenate([one, two + np.uint32(1), three + np.uint32(2)])
    return ((out ^ (out >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19)).astype(np.int64)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1/-1; each column has both signs (but for n = 1), and rows are far from each other.

    Up to five languages get the exhaustive code (all splits in two), more of them the best of 200 random codes.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        splits = np.arange(1, 1 << (n - 1))
        return 1.0 - 2.0 * ((splits[None, :] >> np.arange(n)[:, None]) & 1)
    rng = np.random.default_rng(seed)
    bits = 15 * int(np.ceil(np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        if (abs(code.sum(axis=0)) == n).any():
            continue
        apart = ((bits - code @ code.T) / 2 + bits * np.eye(n)).min()
        if apart > far:
            best, far = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    centre: np.ndarray  # per bit, the mean margin between the two sides
    scale: np.ndarray  # per bit, half the distance of the two sides
    trust: np.ndarray  # per bit, the weight of its loss; they add up to the number of bits

    def scores(self, text: str | None) -> np.ndarray | None:
        """For each language 0 to 1, adding up to 1; None if the text has no letter."""
        found = grams(text or "")
        if not len(found) or not self.languages:
            return None
        counts = np.bincount(found, minlength=BUCKETS).astype(np.float32)
        margin = (counts @ self.weights / len(found) - self.centre) / self.scale
        loss = np.logaddexp(0, -STEEPNESS * self.code * margin) @ self.trust
        odds = np.exp(loss.min() - loss)
        return odds / odds.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        scores = self.scores(text)
        if scores is None:
            return UNDETERMINED, 0.0, True
        best = int(scores.argmax())
        second = float(np.delete(scores, best).max()) if len(scores) > 1 else 0.0
        return self.languages[best], float(scores[best]), float(scores[best]) - second < AMBIGUOUS


def train(docs: DataFrame) -> Model:
    """Learn from the text and the non-null lang of the rows of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                mine = tables.setdefault(lang.as_py(), np.zeros(BUCKETS, dtype=np.int64))
                mine += np.bincount(grams(text.as_py()), minlength=BUCKETS)
        for lang, mine in tables.items():
            used = np.flatnonzero(mine)
            yield pa.record_batch([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(mine[used])], ["lang", "bucket", "n"])

    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counted = known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()  # at most languages x BUCKETS rows
    names = rows.column("lang").to_pylist()
    languages = sorted(set(names))
    per_language = np.zeros((len(languages), BUCKETS))
    at = {name: i for i, name in enumerate(languages)}
    np.add.at(per_language, ([at[x] for x in names], rows.column("bucket").to_numpy()), rows.column("n").to_numpy())
    return fit(languages, per_language)


def fit(languages: list[str], counts: np.ndarray) -> Model:
    code = codewords(len(languages))
    share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)  # each language counts alike
    plus = np.stack([share[code[:, b] > 0].mean(axis=0) for b in range(code.shape[1])], axis=1) if len(languages) else np.ones((BUCKETS, 1))
    if len(languages) < 2:
        flat = np.ones(code.shape[1])
        return Model(languages, code, np.zeros((BUCKETS, code.shape[1]), np.float32), 0 * flat, flat, flat)
    minus = np.stack([share[code[:, b] < 0].mean(axis=0) for b in range(code.shape[1])], axis=1)
    weights = np.log(plus) - np.log(minus)
    high, low = (plus * weights).sum(axis=0), (minus * weights).sum(axis=0)
    apart = np.maximum(high - low, 1e-9)
    return Model(languages, code, weights.astype(np.float32), (high + low) / 2, apart / 2, apart / apart.mean())


def held_out(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3) == 1


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_ambiguous added (replacing columns of these names)."""
    new = ["lang_pred", "lang_score", "lang_ambiguous"]
    kept = [c for c in docs.columns if c not in new]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know = shared.value
        for batch in batches:
            found = [know.predict(t.as_py()) for t in batch.column("text")]
            added = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.record_batch([batch.column(c) for c in kept] + added, kept + new)

    plain = docs.select(*kept)
    schema = plain.schema.add("lang_pred", "string").add("lang_score", "double").add("lang_ambiguous", "boolean")
    return docs.select(*kept).mapInArrow(run, schema)


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """(r, lang_pred, lang_score, lang_ambiguous): ``predict`` with each row of ``docs`` as a struct, whatever its columns
    are called."""
    named = rows_as(docs).select("r", F.col("r.text").cast("string").alias("text"))
    return predict(named, model).drop("text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    asked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    out = predict(asked, model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
