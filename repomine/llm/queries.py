"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from repomine.llm import (
    alignment, chat_format, decontaminate, html_extract, mixing, packing, quality, runs, simhash, spotsigs, substring,
    token_counts, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_packing": packing.op6_packing,
    "op7_simhash": simhash.op7_simhash,
    "op8_spotsigs": spotsigs.op8_spotsigs,
    "op9_quality": quality.op9_quality,
    "op10_substring": substring.op10_substring,
    "op11_mixing": mixing.op11_mixing,
    "op12_runs": runs.op12_runs,
    "op13_alignment": alignment.op13_alignment,
}

# The other queries hash with XXH64, draw, tokenize, train a model, read HTML or compare all periods; tests compare them with brute force.
ORACLE: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op5_chat_format": chat_format.ORACLE,
    "op10_substring": substring.ORACLE,
}
