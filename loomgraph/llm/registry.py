"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from loomgraph.llm import decontaminate, language, lines, media, neardup, negatives, pack, periods, quality, substrings, tokens, toxicity, urls


def queries():
    return {
        "op1_media_columns": media.op1_media_columns,
        "op2_identify_language": language.op2_identify_language,
        "op3_near_duplicates": neardup.op3_near_duplicates,
        "op4_count_tokens": tokens.op4_count_tokens,
        "op5_pack_documents": pack.op5_pack_documents,
        "op6_score_quality": quality.op6_score_quality,
        "op7_remove_lines": lines.op7_remove_lines,
        "op8_remove_substrings": substrings.op8_remove_substrings,
        "op9_score_toxicity": toxicity.op9_score_toxicity,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_periodic_runs": periods.op11_periodic_runs,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "op13_filter_urls": urls.op13_filter_urls,
    }


def oracle_sql():
    return {
        "op3_near_duplicates": neardup.ORACLE_SQL,
        "op7_remove_lines": lines.ORACLE_SQL,
        "op8_remove_substrings": substrings.ORACLE_SQL,
        "op10_decontaminate": decontaminate.ORACLE_SQL,
        "op11_periodic_runs": periods.ORACLE_SQL,
        "op12_hard_negatives": negatives.ORACLE_SQL,
        "op13_filter_urls": urls.ORACLE_SQL,
    }
