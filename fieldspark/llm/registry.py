"""The operators' queries and their DuckDB counterparts."""

from __future__ import annotations

import corpus_pipeline
from fieldspark.llm import bpe, chat, decontaminate, langid, licenses, linededup, passages, quality, simhash, tokencounts


def queries() -> dict:
    return {
        "op1_line_dedup": linededup.query,
        "op2_token_counts": tokencounts.query,
        "op3_benchmark_decontamination": decontaminate.query,
        "op4_quality_rules": quality.query,
        "op5_chat_formatting": chat.query,
        "op6_substring_dedup": passages.query,
        "op7_byte_bpe": bpe.query,
        "op8_simhash_near_dedup": simhash.query,
        "op9_license_scans": licenses.query,
        "op10_language_id": langid.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": linededup.SQL, "op4_quality_rules": quality.SQL, "op5_chat_formatting": chat.SQL}
