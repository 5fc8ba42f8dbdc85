"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import bpe, chat, counts, near, oracles, packing, pii, quality, syncmers, tokenfile, urls


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_packing": packing.op2_packing,
        "op3_pii": pii.op3_pii,
        "op4_syncmers": syncmers.op4_syncmers,
        "op5_quality": quality.op5_quality,
        "op6_counts": counts.op6_counts,
        "op7_urls": urls.op7_urls,
        "op8_near": near.op8_near,
        "op9_token_files": tokenfile.op9_token_files,
        "op10_chat": chat.op10_chat,
    }


def oracle_sql() -> dict[str, str]:
    """Of the two that SQL can express; the others rest on byte-pair ids, ciphers or hash functions that it lacks."""
    return {"op5_quality": oracles.op5(), "op8_near": oracles.op8()}
