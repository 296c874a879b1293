"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, compression, html_text, language_id, lexical, ngram_join, packing, pii, quality_rules, topk, url_rules, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_bpe": bpe.op2_bpe,
        "op3_quality_classifier": compression.op3_quality_classifier,
        "op4_warc": warc.op4_warc,
        "op5_language_id": language_id.op5_language_id,
        "op6_pii": pii.op6_pii,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_packing": packing.op8_packing,
        "op9_html_text": html_text.op9_html_text,
        "op10_topk_search": topk.op10_topk_search,
        "op11_collocations": collocations.op11_collocations,
        "op12_url_rules": url_rules.op12_url_rules,
        "op13_lexical_search": lexical.op13_lexical_search,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.OP1_SQL,
        "op4_warc": warc.OP4_SQL,
        "op7_ngram_join": ngram_join.OP7_SQL,
        "op10_topk_search": topk.OP10_SQL,
        "op11_collocations": collocations.OP11_SQL,
        "op12_url_rules": url_rules.OP12_SQL,
        "op13_lexical_search": lexical.OP13_SQL,
    }
