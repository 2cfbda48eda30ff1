"""Registered queries of this package and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelens.llm import (
    code_bounds,
    cross_parsing,
    deletion_signatures,
    exact_topk,
    huffman,
    merkle,
    mixing,
    multi_index,
    order_minhash,
    piece_lattice,
    recurrent_lm,
    url_rules,
    wrapper_induction,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cross_parsing": cross_parsing.query,
    "op2_wrapper_induction": wrapper_induction.query,
    "op3_token_ids": huffman.query,
    "op4_order_minhash": order_minhash.query,
    "op5_mix_sources": mixing.query,
    "op6_multi_index": multi_index.query,
    "op7_exact_topk": exact_topk.query,
    "op8_url_rules": url_rules.query,
    "op9_recurrent_lm": recurrent_lm.query,
    "op10_piece_lattice": piece_lattice.query,
    "op11_deletion_signatures": deletion_signatures.query,
    "op12_merkle_manifest": merkle.query,
    "op13_code_bounds": code_bounds.query,
}

ORACLE: dict[str, str] = {
    "op5_mix_sources": mixing.SQL,
    "op7_exact_topk": exact_topk.SQL,
    "op8_url_rules": url_rules.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_code_bounds": code_bounds.SQL,
}
