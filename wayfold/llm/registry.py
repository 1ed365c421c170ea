"""Queries of the pipeline operators and the SQL that some of them equal."""

from __future__ import annotations

from wayfold.llm import alignment, exact_dedup, language_id, line_dedup, lm_score, near_dedup, packing, personal_data, resampling, secret_scan, token_files, vector_search, word_bpe


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_top_k": vector_search.op2_top_k,
        "op3_token_files": token_files.op3_token_files,
        "op4_packing": packing.op4_packing,
        "op5_word_bpe": word_bpe.op5_word_bpe,
        "op6_language_id": language_id.op6_language_id,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_near_dedup": near_dedup.op8_near_dedup,
        "op9_lm_score": lm_score.op9_lm_score,
        "op10_secret_scan": secret_scan.op10_secret_scan,
        "op11_personal_data": personal_data.op11_personal_data,
        "op12_resampling": resampling.op12_resampling,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE,
        "op2_top_k": vector_search.ORACLE,
        "op7_line_dedup": line_dedup.ORACLE,
        "op8_near_dedup": near_dedup.ORACLE,
        "op10_secret_scan": secret_scan.ORACLE,
        "op12_resampling": resampling.ORACLE,
    }
