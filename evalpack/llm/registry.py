"""The queries of this subpackage and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import conversation_repair, decontaminate, exact_dedup, html_text, licenses, near_dedup, packing, pii, prefix_trie, quality, secrets, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_html_extraction": html_text.op5_html_extraction,
        "op6_quality_classifier": quality.op6_quality_classifier,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_pii": pii.op8_pii,
        "op9_decontamination": decontaminate.op9_decontamination,
        "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
        "op11_conversation_repair": conversation_repair.op11_conversation_repair,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_url_filter": url_filter.op13_url_filter,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.ORACLE, "op11_conversation_repair": conversation_repair.ORACLE,
            "op12_prefix_trie": prefix_trie.ORACLE, "op13_url_filter": url_filter.ORACLE}
