"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import exact_dedup, minhash, mixing, packing, pii, quality, simhash, token_scan, toxicity, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_minhash": minhash.query,
    "op3_token_scan": token_scan.query,
    "op4_pii": pii.query,
    "op5_toxicity": toxicity.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_simhash": simhash.query,
    "op8_quality": quality.query,
    "op9_packing": packing.query,
    "op10_mixing": mixing.query,
}
SQL = {
    "op6_exact_dedup": exact_dedup.SQL,
}
