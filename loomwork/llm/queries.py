"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import ann, bpe, html, media, mixing, neardup, outliers, pii, runs, secrets, sharding, toxicity, turns


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_pii": pii.op2_pii,
        "op3_bpe_encode": bpe.op3_bpe_encode,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_html_extraction": html.op5_html_extraction,
        "op6_media_columns": media.op6_media_columns,
        "op7_ann_search": ann.op7_ann_search,
        "op8_mixing": mixing.op8_mixing,
        "op9_minhash_neardup": neardup.op9_minhash_neardup,
        "op10_sharding": sharding.op10_sharding,
        "op11_periodic_runs": runs.op11_periodic_runs,
        "op12_quality_rules": outliers.op12_quality_rules,
        "op13_conversation_repair": turns.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {}
