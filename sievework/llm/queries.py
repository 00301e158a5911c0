"""The contract queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from sievework.llm import bpe, collocations, fingerprints, licenses, linededup, packing, pairbpe, quality, resampling, sharding, simhash, toxicity, urlfilter

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_fingerprints": fingerprints.op1_fingerprints,
        "op2_license_scans": licenses.op2_license_scans,
        "op3_simhash": simhash.op3_simhash,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_sharding": sharding.op5_sharding,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_line_dedup": linededup.op7_line_dedup,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_packing": packing.op9_packing,
        "op10_url_filters": urlfilter.op10_url_filters,
        "op11_collocations": collocations.op11_collocations,
        "op12_pair_bpe": pairbpe.op12_pair_bpe,
        "op13_resampling": resampling.op13_resampling,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op7_line_dedup": linededup.OP7_SQL, "op10_url_filters": urlfilter.OP10_SQL, "op11_collocations": collocations.OP11_SQL, "op13_resampling": resampling.OP13_SQL}
    return found if corpus_pipeline.ORACLE_SQL is None else found | {"pipeline": corpus_pipeline.ORACLE_SQL}
