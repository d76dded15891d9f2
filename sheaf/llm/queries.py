"""The queries of this subpackage, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import counts, langid, media, mixing, packing, simhash, sketch, tokenfiles, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.op1,
        "op2_toxicity": toxicity.op2,
        "op3_fingerprints": sketch.op3,
        "op4_language": langid.op4,
        "op5_token_files": tokenfiles.op5,
        "op6_packing": packing.op6,
        "op7_media": media.op7,
        "op8_token_counts": counts.op8,
        "op9_mixing": mixing.op9,
        "op10_url_filter": urls.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": mixing.OP9_SQL, "op10_url_filter": urls.OP10_SQL}
