"""The queries of this subpackage, over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carefold.llm import bpe, centroids, decontam, dialogs, langid, linededup, pii, quality, simhash, substring, token_counts, token_files, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": bpe.query,
        "op2_substring_dedup": substring.query,
        "op3_language_id": langid.query,
        "op4_token_files": token_files.query,
        "op5_simhash": simhash.query,
        "op6_token_counts": token_counts.query,
        "op7_pii": pii.query,
        "op8_decontamination": decontam.query,
        "op9_quality_rules": quality.query,
        "op10_line_dedup": linededup.query,
        "op11_centroid_clustering": centroids.query,
        "op12_warc": warc.query,
        "op13_conversation_repair": dialogs.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_quality_rules": quality.ORACLE, "op10_line_dedup": linededup.ORACLE, "op11_centroid_clustering": centroids.ORACLE, "op12_warc": warc.ORACLE}
