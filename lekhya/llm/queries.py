"""Registered queries of the training-text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lekhya.llm import canonical, encoding, mixing, pii, scans, tokens, visual

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": canonical.p1_found,
        "p1_unmatched": canonical.p1_unmatched,
        "p1_candidates": canonical.p1_candidates,
        "p4_found": scans.p4_found,
        "p4_corrections": scans.p4_corrections,
        "p4_confusions": scans.p4_confusions,
        "p4_heads": scans.p4_heads,
        "p4_repaired": scans.p4_repaired,
        "p5_found": visual.p5_found,
        "p5_unified": visual.p5_unified,
        "p5_values": visual.p5_values,
        "p7_found": encoding.p7_found,
        "p7_restored": encoding.p7_restored,
        "p8_ids": tokens.p8_ids,
        "p8_counts": tokens.p8_counts,
        "p9_mix": mixing.p9_mix,
        "p9_report": mixing.p9_report,
        "p10_found": pii.p10_found,
        "p10_redacted": pii.p10_redacted,
        "p10_report": pii.p10_report,
    }


def oracle_sql() -> dict[str, str]:
    return {}
