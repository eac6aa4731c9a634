"""Queries of this subpackage by name, and the SQL that gives the same rows where there is any."""

from __future__ import annotations

from . import exact_dedup, language_id, minhash, packing, pii, quality, run_index, sentencepieces, token_planes, warc

QUERIES = {
    "op1_token_planes": token_planes.query,
    "op2_warc": warc.query,
    "op3_packing": packing.query,
    "op4_quality": quality.query,
    "op5_run_index": run_index.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_pii": pii.query,
    "op8_minhash": minhash.query,
    "op9_sentencepieces": sentencepieces.query,
    "op10_language_id": language_id.query,
}

ORACLES = {
    "op2_warc": warc.ORACLE,
    "op4_quality": quality.ORACLE,
    "op5_run_index": run_index.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op8_minhash": minhash.ORACLE,
}
