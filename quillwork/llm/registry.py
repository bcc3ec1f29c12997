"""Queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, decontaminate, exact_dedup, fim, html_text, jaccard, langid, lexical_search, line_dedup, mixing, quality, sharding, substring_dedup


def queries():
    return {
        "op1_substring_dedup": substring_dedup.op1_query,
        "op2_line_dedup": line_dedup.op2_query,
        "op2_line_dedup_whole": line_dedup.op2_whole_query,
        "op3_byte_bpe": bpe.op3_query,
        "op4_mixing": mixing.op4_query,
        "op5_exact_dedup": exact_dedup.op5_query,
        "exact_dedup_batches": exact_dedup.two_batches_query,
        "op6_html_text": html_text.op6_query,
        "op7_quality_rules": quality.op7_query,
        "op8_kd_sharding": sharding.op8_query,
        "op9_language_id": langid.op9_query,
        "language_id_pages": langid.pages_query,
        "op10_jaccard_join": jaccard.op10_query,
        "op11_lexical_search": lexical_search.op11_query,
        "op12_decontamination": decontaminate.op12_query,
        "op13_fill_in_middle": fim.op13_query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op2_line_dedup": line_dedup.OP2_SQL,
        "op2_line_dedup_whole": line_dedup.OP2_WHOLE_SQL,
        "op5_exact_dedup": exact_dedup.OP5_SQL,
        "exact_dedup_batches": exact_dedup.TWO_BATCHES_SQL,
        "op10_jaccard_join": jaccard.OP10_SQL,
        "op11_lexical_search": lexical_search.OP11_SQL,
        "op12_decontamination": decontaminate.OP12_SQL,
        "op13_fill_in_middle": fim.OP13_SQL,
    }
