"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidewarden.llm import (
    collocations,
    conversation_repair,
    decontamination,
    html_extraction,
    mixing,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    secret_scan,
    simhash,
    token_output,
    url_filters,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_quality_classifier": quality_classifier.op2_quality_classifier,
        "op3_token_output": token_output.op3_token_output,
        "op4_secret_scan": secret_scan.op4_secret_scan,
        "op5_html_extraction": html_extraction.op5_html_extraction,
        "op6_pii": pii.op6_pii,
        "op7_mixing": mixing.op7_mixing,
        "op8_url_filters": url_filters.op8_url_filters,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_simhash": simhash.op10_simhash,
        "op11_conversation_repair": conversation_repair.op11_conversation_repair,
        "op12_packing": packing.op12_packing,
        "op13_collocations": collocations.op13_collocations,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op1_decontamination": decontamination.ORACLE,
        "op4_secret_scan": secret_scan.ORACLE,
        "op8_url_filters": url_filters.ORACLE,
        "op9_quality_rules": quality_rules.ORACLE,
        "op11_conversation_repair": conversation_repair.ORACLE,
        "op13_collocations": collocations.ORACLE,
    }
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
