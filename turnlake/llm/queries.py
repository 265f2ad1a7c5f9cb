"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnlake.llm import bpe, chat_format, decontamination, exact_dedup, fill_middle, filter_audit, fingerprints, line_dedup, mixing, near_dedup, passages, quality, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_passages": passages.op2_passages,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_fingerprints": fingerprints.op4_fingerprints,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_mixing": mixing.op6_mixing,
        "op7_chat_format": chat_format.op7_chat_format,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_quality": quality.op9_quality,
        "op10_near_dedup": near_dedup.op10_near_dedup,
        "op11_decontamination": decontamination.op11_decontamination,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_fill_middle": fill_middle.op13_fill_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_mixing": mixing.OP6_SQL,
        "op7_chat_format": chat_format.OP7_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
        "op11_decontamination": decontamination.OP11_SQL,
        "op12_filter_audit": filter_audit.OP12_SQL,
        "op13_fill_middle": fill_middle.OP13_SQL,
    }
