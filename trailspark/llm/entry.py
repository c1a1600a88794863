"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, decontam, htmltext, licenses, linededup, ngramjoin, phrases, pieces, quality, secrets, simhash, toxicity
from .common import table


def piece_model() -> str:
    """The public vocabulary's file; every executor has the same package."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_bpe() -> str:
    """The public byte-level vocabulary's file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_ranks() -> str:
    """A public vocabulary in the order of its ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nearest": lambda spark, d: ann.report(table(spark, d, "embeddings")),
        "op2_license_scan": lambda spark, d: licenses.report(table(spark, d, "documents")),
        "op3_decontamination": lambda spark, d: decontam.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op4_line_dedup": lambda spark, d: linededup.report(table(spark, d, "documents")),
        "op5_toxicity": lambda spark, d: toxicity.report(table(spark, d, "documents"), table(spark, d, "labels")),
        "op6_secret_scan": lambda spark, d: secrets.report(table(spark, d, "documents"), word_ranks()),
        "op7_ngram_jaccard_join": lambda spark, d: ngramjoin.report(table(spark, d, "documents")),
        "op8_sentencepiece": lambda spark, d: pieces.digests(table(spark, d, "documents"), piece_model()),
        "op9_html_text": lambda spark, d: htmltext.extract(table(spark, d, "pages")),
        "op10_quality": lambda spark, d: quality.report(table(spark, d, "documents"), table(spark, d, "labels")),
        "op11_simhash": lambda spark, d: simhash.report(table(spark, d, "documents")),
        "op12_token_alignment": lambda spark, d: alignment.report(table(spark, d, "documents"), byte_bpe(), piece_model()),
        "op13_phrases": lambda spark, d: phrases.report(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licenses.report_sql(), "op4_line_dedup": linededup.report_sql(), "op13_phrases": phrases.report_sql()}
