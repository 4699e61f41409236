"""Queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from loomwright.llm import bpe, language_id, line_dedup, media, mixing, packing, quality_rules, secret_scan, simhash, toxicity
from loomwright.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _docs(fn):
    return lambda spark, sf_dir: fn(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_toxicity": lambda spark, sf_dir: toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op2_byte_bpe": _docs(lambda d: bpe.round_trip(d, RANKS, public_tokenizers.PATTERN)),
        "op3_secret_scan": _docs(secret_scan.scan),
        "op4_token_packing": _docs(lambda d: packing.pack(d, RANKS, public_tokenizers.PATTERN)),
        "op5_language_id": _docs(language_id.predict),
        "op6_quality_rules": _docs(quality_rules.verdicts),
        "op7_media_columns": _docs(media.digests),
        "op8_simhash_golay": _docs(simhash.near_duplicates),
        "op9_line_dedup": _docs(line_dedup.line_report),
        "op10_source_mixing": _docs(mixing.mix),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_secret_scan": secret_scan.oracle(), "op6_quality_rules": quality_rules.oracle(), "op10_source_mixing": mixing.oracle()}
