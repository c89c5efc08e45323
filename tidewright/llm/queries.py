"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import fingerprints, mixing, near_dedup, packing, pii, quality_rules, suffix_dedup, token_counts, token_files, warc


def word_tokenizer() -> str:
    """Path of the vocabulary that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _read(name: str, apply: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: apply(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": _read("documents", suffix_dedup.without_repeats),
    "op2_mix_sources": _read("documents", mixing.mixed),
    "op3_token_counts": _read("documents", lambda d: token_counts.token_counts(d, word_tokenizer())),
    "op4_token_files": _read("documents", lambda d: token_files.token_files(d, word_tokenizer())),
    "op5_pii": _read("documents", pii.pii_report),
    "op6_fingerprints": _read("documents", fingerprints.fingerprint_report),
    "op7_warc": _read("pages", warc.warc_round_trip),
    "op8_near_dedup": _read("documents", near_dedup.near_classes),
    "op9_packing": _read("documents", lambda d: packing.packed(d, word_tokenizer())),
    "op10_quality_rules": _read("documents", quality_rules.quality_rules),
}

SQL: dict[str, str] = {"op2_mix_sources": mixing.SQL, "op7_warc": warc.SQL}
