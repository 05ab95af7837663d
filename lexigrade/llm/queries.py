"""The queries of the llm operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, kd_shards, license_scan, mixing, ngram_join, quality, secrets, sentencepieces, url_filter, va_topk, warc, winnow

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_sentencepiece": sentencepieces.op1_sentencepiece,
        "op2_warc": warc.op2_warc,
        "op3_secret_scan": secrets.op3_secret_scan,
        "op4_va_topk": va_topk.op4_va_topk,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op6_mixing": mixing.op6_mixing,
        "op7_fingerprints": winnow.op7_fingerprints,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_quality": quality.op9_quality,
        "op10_license_scan": license_scan.op10_license_scan,
        "op11_collocations": collocations.op11_collocations,
        "op12_kd_shards": kd_shards.op12_kd_shards,
        # What SQL can say of operators that it cannot express as a whole.
        "fixed_mixing": mixing.fixed_columns,
        "fixed_fingerprints": winnow.fixed_columns,
        "fixed_license_scan": license_scan.fixed_columns,
        "fixed_sharding": kd_shards.fixed_columns,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.ORACLE_SQL,
        "op3_secret_scan": secrets.oracle_sql(),
        "op4_va_topk": va_topk.ORACLE_SQL,
        "op5_ngram_join": ngram_join.ORACLE_SQL,
        "op8_url_filter": url_filter.oracle_sql(),
        "op11_collocations": collocations.ORACLE_SQL,
        "fixed_mixing": mixing.FACTS_SQL,
        "fixed_fingerprints": winnow.FACTS_SQL,
        "fixed_license_scan": license_scan.FACTS_SQL,
        "fixed_sharding": kd_shards.FACTS_SQL,
    }
