"""The queries of this subpackage, by name, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termweave.llm import centroids, chat, decontaminate, filter_audit, linededup, lm, neardup, packing, quality, token_count, topk, toxicity, urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": neardup.op1_near_dedup,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_lm_scores": lm.op3_lm_scores,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_exact_topk": topk.op5_exact_topk,
        "op6_token_counts": token_count.op6_token_counts,
        "op7_url_filter": urlfilter.op7_url_filter,
        "op8_substring_dedup": linededup.op8_substring_dedup,
        "op9_packing": packing.op9_packing,
        "op10_quality": quality.op10_quality,
        "op11_chat_format": chat.op11_chat_format,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_centroids": centroids.op13_centroids,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_topk": topk.OP5_SQL,
        "op7_url_filter": urlfilter.OP7_SQL,
        "op11_chat_format": chat.OP11_SQL,
        "op12_filter_audit": filter_audit.OP12_SQL,
        "op13_centroids": centroids.OP13_SQL,
    }
