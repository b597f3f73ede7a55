"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import bpe, exact, language, lines, mixing, passages, quality, resample, secrets, simhash, variants, warc, wordbpe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.op1_bpe,
    "op2_mix": mixing.op2_mix,
    "op3_passages": passages.op3_passages,
    "op4_simhash": simhash.op4_simhash,
    "op5_secrets": secrets.op5_secrets,
    "op6_warc": warc.op6_warc,
    "op7_exact": exact.op7_exact,
    "op8_lines": lines.op8_lines,
    "op9_language": language.op9_language,
    "op10_quality": quality.op10_quality,
    "op11_wordbpe": wordbpe.op11_wordbpe,
    "op12_variants": variants.op12_variants,
    "op13_resample": resample.op13_resample,
}

ORACLES: dict[str, str] = {
    "op7_exact": exact.ORACLE,
    "op12_variants": variants.ORACLE,
    "op13_resample": resample.ORACLE,
}
