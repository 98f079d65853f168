"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat, decontaminate, language, licenses, linededup, mixing, negatives, neighbours, quality, secrets, simhash, spelling, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_url_filters": urls.op3_url_filters,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_language_id": language.op5_language_id,
    "op6_simhash_dedup": simhash.op6_simhash_dedup,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_nearest_neighbours": neighbours.op13_nearest_neighbours,
}

SQL: dict[str, str] = {
    "op2_license_scan": licenses.OP2_SQL,
    "op3_url_filters": urls.OP3_SQL,
    "op7_mix_sources": mixing.OP7_SQL,
    "op9_chat_formatting": chat.OP9_SQL,
    "op10_quality_rules": quality.OP10_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op12_spelling_variants": spelling.OP12_SQL,
}
