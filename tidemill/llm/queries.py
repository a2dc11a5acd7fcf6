"""The registered corpus queries and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import decontaminate, html_text, mixing, quality, secrets, sharding, simhash, tokens, url_rules, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.query,
        "op2_warc": warc.query,
        "op3_decontamination": decontaminate.query,
        "op4_html_text": html_text.query,
        "op5_secrets": secrets.query,
        "op6_mixing": mixing.query,
        "op7_token_counts": tokens.query,
        "op8_url_rules": url_rules.query,
        "op9_quality_rules": quality.query,
        "op10_sharding": sharding.query,
        "quality_ablation": quality.ablation_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.ORACLE_SQL,
        "op3_decontamination": decontaminate.ORACLE_SQL,
        "op5_secrets": secrets.ORACLE_SQL,
        "op6_mixing": mixing.ORACLE_SQL,
        "op9_quality_rules": quality.ORACLE_SQL,
        "op10_sharding": sharding.ORACLE_SQL,
        "quality_ablation": quality.ABLATION_SQL,
    }
