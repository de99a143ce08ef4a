"""Queries of the corpus operators over the given tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from textloom.llm import decontaminate, html_text, line_dedup, merkle, minhash, mixing, pii, quality_cnn, runs, secret_scan, substring_dedup, token_count, topk


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_topk_search": topk.op1,
        "op2_substring_dedup": substring_dedup.op2,
        "op3_token_counts": token_count.op3,
        "op4_decontamination": decontaminate.op4,
        "op5_quality_classifier": quality_cnn.op5,
        "op6_line_dedup": line_dedup.op6,
        "op7_html_extraction": html_text.op7,
        "op8_near_dedup": minhash.op8,
        "op9_source_mixing": mixing.op9,
        "op10_secret_scan": secret_scan.op10,
        "op11_merkle_manifest": merkle.op11,
        "op12_periodic_runs": runs.op12,
        "op13_personal_data": pii.op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk_search": topk.OP1_SQL,
        "op2_substring_dedup": substring_dedup.OP2_SQL,
        "op4_decontamination": decontaminate.OP4_SQL,
        "op6_line_dedup": line_dedup.OP6_SQL,
        "op8_near_dedup": minhash.OP8_SQL,
        "op11_merkle_manifest": merkle.OP11_SQL,
    }
