"""A corpus pipeline of five stages over ``documents``; each stage works on all that the one before it kept.

Null doc_ids, empty texts and repeated rows are handled as the operators of carefold.llm say. All stages but the last
return the columns of their input, whatever extra ones it has, in its order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carefold.llm import bpe, decontam, langid, linededup, nearcopies
from carefold.llm._common import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a determinable language (null, empty and letterless texts among them).

    The classifiers learn from the labels of the rows that are not held out; without any label every document goes.
    """
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.judge(docs, model).filter(F.col("lang_pred") != langid.UNDETERMINED).select("r.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the least doc_id only; texts left without a word go (null ones too).

    n_chars, if there is such a column, follows the text.
    """
    left = linededup.dedup(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast("long"))
    return left


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group linked at a five-word Jaccard similarity of 0.8 or more.

    SimHash leads each document to one to compare; ``nearcopies`` says why a limit of bits alone can't decide.
    """
    return nearcopies.one_of_each(docs)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose tiles cover half of a benchmark item's words; an empty benchmark drops none."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left, a row for each."""
    import public_tokenizers

    return bpe.round_trip(docs, bpe.ByteBpe.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken")))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", remove_benchmark_passages),
    ("byte-level BPE", encode),
]

#: Language ID, SimHash components and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i}")
    return docs
