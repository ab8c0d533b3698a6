"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bloom_cascade, chat_format, circulant_minhash, mixing, prefix_join, prefix_trie, pu_quality, quality_rules, recompression, token_files, toxicity, trie_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_prefix_join": prefix_join.op1_prefix_join,
        "op2_repair_tokens": token_files.op2_repair_tokens,
        "op3_bloom_cascade": bloom_cascade.op3_bloom_cascade,
        "op4_prefix_target": chat_format.op4_prefix_target,
        "op5_block_mix": mixing.op5_block_mix,
        "op6_pu_quality": pu_quality.op6_pu_quality,
        "op7_trie_counts": trie_counts.op7_trie_counts,
        "op8_circulant_minhash": circulant_minhash.op8_circulant_minhash,
        "op9_boosted_rules": quality_rules.op9_boosted_rules,
        "op10_factorization_machine": toxicity.op10_factorization_machine,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_recompression": recompression.op13_recompression,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_prefix_join": prefix_join.OP1_SQL,
        "op3_bloom_cascade": bloom_cascade.OP3_SQL,
        "op4_prefix_target": chat_format.OP4_SQL,
        "op8_circulant_minhash": circulant_minhash.OP8_SQL,
        "op12_prefix_trie": prefix_trie.OP12_SQL,
        "op13_recompression": recompression.OP13_SQL,
    }
