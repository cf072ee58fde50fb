"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notegraph.llm import bitplanes, dedup, fingerprints, licenses, merkle, mixing, packing, pii, quality, secrets, simhash, tokens, toxicity
from notegraph.llm.common import documents, labels, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": lambda spark, sf: toxicity.op1(spark, documents(spark, sf), labels(spark, sf)),
        "op2_source_mix": lambda spark, sf: mixing.op2(spark, documents(spark, sf)),
        "op3_pii": lambda spark, sf: pii.op3(spark, documents(spark, sf)),
        "op4_quality_rules": lambda spark, sf: quality.op4(spark, documents(spark, sf), labels(spark, sf)),
        "op5_token_counts": lambda spark, sf: tokens.op5(spark, documents(spark, sf)),
        "op6_license_scan": lambda spark, sf: licenses.op6(spark, documents(spark, sf)),
        "op7_simhash": lambda spark, sf: simhash.op7(spark, documents(spark, sf)),
        "op8_packing": lambda spark, sf: packing.op8(spark, documents(spark, sf)),
        "op9_exact_dedup": lambda spark, sf: dedup.op9(spark, documents(spark, sf)),
        "op10_secrets": lambda spark, sf: secrets.op10(spark, documents(spark, sf)),
        "op11_merkle": lambda spark, sf: merkle.op11(spark, documents(spark, sf)),
        "op12_bitplane_clusters": lambda spark, sf: bitplanes.op12(spark, vectors(spark, sf)),
        "op13_fingerprints": lambda spark, sf: fingerprints.op13(spark, documents(spark, sf)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_exact_dedup": dedup.ORACLE, "op11_merkle": merkle.ORACLE, "op12_bitplane_clusters": bitplanes.ORACLE}
