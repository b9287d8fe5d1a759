"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontam, neardup, packing, pii, quality, secrets, sharding, substrings, tokens, warc


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_quality": quality.op2_quality,
        "op3_near_dedup": neardup.op3_near_dedup,
        "op4_warc": warc.op4_warc,
        "op5_packing": packing.op5_packing,
        "op6_tokens": tokens.op6_tokens,
        "op7_decontam": decontam.op7_decontam,
        "op8_pii": pii.op8_pii,
        "op9_substrings": substrings.op9_substrings,
        "op10_secrets": secrets.op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.oracle(), "op2_quality": quality.oracle(), "op3_near_dedup": neardup.ORACLE, "op4_warc": warc.ORACLE, "op9_substrings": substrings.ORACLE}
