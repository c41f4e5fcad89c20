"""The registered queries of this subpackage and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailveil.llm import bpe, decontaminate, divergence, extraction, fixity, jaccard, lines, pitman_yor, quality, secrets, toxicity, urls, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.query,
    "op2_decontamination": decontaminate.query,
    "op3_secrets": secrets.query,
    "op4_pitman_yor": pitman_yor.query,
    "op5_line_quality": lines.query,
    "op6_bpe": bpe.query,
    "op7_html_extraction": extraction.query,
    "op8_warc_fixity": fixity.query,
    "op9_quality_gam": quality.query,
    "op10_jaccard_join": jaccard.query,
    "op11_url_filter": urls.query,
    "op12_source_divergence": divergence.query,
    "op13_vector_codes": vector_codes.query,
}

SQL: dict[str, str] = {"op2_decontamination": decontaminate.SQL, "op8_warc_fixity": fixity.SQL, "op11_url_filter": urls.SQL, "op12_source_divergence": divergence.SQL,
                       "op13_vector_codes": vector_codes.SQL}
